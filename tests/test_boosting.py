"""Second-order boosting against the same trees grown row by row in numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.operators import boosting


def brute_tree(x, g, h, depth, node=0, found=None):
    """{node: (feature, edge) or value}, by trying every split of every node."""
    found = {} if found is None else found
    best = None
    if depth:
        for f in range(x.shape[1]):
            for edge in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= edge
                gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
                gain = round(gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 9)
                if hl >= 1 and hr >= 1 and gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, edge)
    if best is None:
        found[node] = -g.sum() / (h.sum() + 1)
        return found
    _, f, edge = best
    found[node] = (f, edge)
    low = x[:, f] <= edge
    brute_tree(x[low], g[low], h[low], depth - 1, 2 * node + 1, found)
    brute_tree(x[~low], g[~low], h[~low], depth - 1, 2 * node + 2, found)
    return found


def nodes_of(tree):
    found, values, reached = {}, tree.values(1.0), [0]
    for node in reached:
        if tree.feature[node] >= 0:
            found[node] = (tree.feature[node], tree.edge[node])
            reached += [2 * node + 1, 2 * node + 2]
        else:
            found[node] = values[node]
    return found


def predict(found, row):
    node = 0
    while isinstance(found[node], tuple):
        f, edge = found[node]
        node = 2 * node + 1 + (row[f] > edge)
    return found[node]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 30, 400), rng.integers(0, 2, 400), rng.normal(size=400).round(1), np.ones(400)], axis=1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] / 6 - 2.5 + 2 * x[:, 1] * x[:, 2])))).astype(float)
    df = spark.createDataFrame([(i, float(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x, strict=True))], "row_id long, label double, x array<double>")
    return df.repartition(3).persist(), x, y


def test_rounds_equal_brute_force(sample, monkeypatch):
    df, x, y = sample
    monkeypatch.setattr(boosting, "SETTLE_ROUNDS", 2)
    trees = boosting.boost(df, F.col("x"), list("abcd"), 3, 3, 0.3)
    margin = np.zeros(len(y))
    for tree in trees:
        p = 1 / (1 + np.exp(-margin))
        expected = brute_tree(x, p - y, p * (1 - p), 3)
        found = nodes_of(tree)
        assert found.keys() == expected.keys()
        for node, what in expected.items():
            assert found[node] == pytest.approx(what, abs=1e-9)
        margin += 0.3 * np.array([predict(expected, row) for row in x])
    scored = df.select("row_id", boosting.margins(trees, 0.3, F.col("x")).alias("m")).collect()
    assert [r["m"] for r in sorted(scored)] == pytest.approx(margin.tolist(), abs=1e-9)


def test_splits_do_not_depend_on_where_cells_are_summed(sample):
    df, _, _ = sample
    edges = boosting.bin_edges(df, "x", 4)
    rows = df.select("row_id", "label", boosting._binned(F.col("x"), edges).alias("bins"), F.lit(0.0).alias("margin"))
    grown = []
    for partitions, most in ((3, 1 << 22), (10**6, 1 << 22), (3, 0)):  # by the driver, summed by Spark, found by Spark
        tree = boosting.grow_tree(rows, 3, edges, [0, 2, 3], partitions, most=most)
        grown.append(nodes_of(tree))
        assert all(f != 1 for f in tree.feature)
    for other in grown[1:]:
        assert other.keys() == grown[0].keys() and all(other[k] == pytest.approx(grown[0][k]) for k in other)


def test_many_values_get_quantile_bins(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("v")).select(F.array("v", F.lit(1.0), (F.col("v") % 3)).alias("x"))
    edges = boosting.bin_edges(df, "x", 3)
    assert 200 < len(edges[0]) < 256 and edges[1] == [] and edges[2] == [0.0, 1.0]


def test_estimator_learns_and_draws(sample, spark):
    df, _, _ = sample
    vectors = df.withColumn("features", array_to_vector("x"))
    model = boosting.SecondOrderBoosting(maxIter=12, maxDepth=2, stepSize=0.3, seed=5).fit(vectors)
    again = boosting.SecondOrderBoosting(maxIter=12, maxDepth=2, stepSize=0.3, seed=5).fit(vectors.repartition(7))
    rows = sorted(model.transform(vectors).select("row_id", "label", "probability", "prediction").collect())
    repeated = sorted(again.transform(vectors).select("row_id", "label", "probability").collect())
    assert [r["probability"][1] for r in rows] == pytest.approx([r["probability"][1] for r in repeated])
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.75
    assert len({tuple(boosting.chosen_features(Draws(), k, list("abcdefgh"), 0.5)) for k in range(6)}) > 1
    for few in (vectors.limit(0), vectors.where("label = 1")):
        fitted = boosting.SecondOrderBoosting(maxIter=2).fit(few)
        assert all(r["probability"][1] >= 0.5 for r in fitted.transform(vectors).select("probability").collect())


def test_equal_rows_are_passed_once(spark, monkeypatch):
    """Trees of grouped rows are those of all rows, draws included; a round passes the different rows only."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(1.5 - x[:, 0]))).astype(float)
    df = spark.createDataFrame([(i, float(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x, strict=True))], "row_id long, label double, x array<double>")
    grow, passed, found = boosting.grow_tree, [], []

    def counted(rows, *args):
        passed.append(rows.count())
        return grow(rows, *args)

    monkeypatch.setattr(boosting, "grow_tree", counted)
    for choice in (boosting.worth_grouping, lambda *_: False):
        monkeypatch.setattr(boosting, "worth_grouping", choice)
        found.append(boosting.boost(df, F.col("x"), ["a", "b"], 12, 2, 0.3, row_share=0.7, draws=Draws(3)))
    assert max(passed[:12]) <= 32 < min(passed[12:])
    for one, other in zip(*found, strict=True):
        assert list(one.feature) == list(other.feature) and list(one.edge) == list(other.edge)
        assert one.values(0.3) == pytest.approx(other.values(0.3), abs=1e-9)


def test_draws_below_a_share(spark):
    rows = spark.range(2000)
    for draws in (Draws(5), Draws(5, "xxhash64")):
        u = draws.uniform("k", "s", F.col("id"))
        met = rows.select(u.alias("u")).first()["u"]
        for share in (0.0, 1e-9, 0.3, 0.85, met, 1.0, 2.0):
            wrong = rows.where((u < F.lit(share)) != draws.below("k", "s", F.col("id"), share))
            assert wrong.count() == 0
