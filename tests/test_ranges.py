"""Operators that walk values in order: by ranges of few rows they give what one window gives."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tests.rows import people_rows
from veilframe import MaskingConfig, MaskSpec
from veilframe.functions.draws import TRIAL
from veilframe.operators import drift
from veilframe.operators.joins import join_summary
from veilframe.operators.masks import evaluate_masks, wide
from veilframe.operators.moments import masked_cube, moments, original_cube
from veilframe.operators.neighbours import digamma, nearest_information
from veilframe.operators.project import text_codes
from veilframe.operators.ranking import running_totals
from veilframe.sources.tables import read_numbered


@pytest.mark.parametrize("part_rows", [1, 10, 1000])
def test_running_totals_of_a_hot_key(spark, part_rows):
    rows = [("hot", i * 7 % 400, i) for i in range(400)] + [(None, i, 1) for i in range(5)] + [("b", 3, 2)]
    df = spark.createDataFrame(rows, "k string, v int, n int").repartition(6)
    found = {(r["k"], r["v"]): (r["n_upto"], r["following"]) for r in running_totals(df, ["k"], "v", ["n"], part_rows).collect()}
    expected = {}
    for key in ("hot", None, "b"):
        total, mine = 0, sorted((v, n) for k, v, n in rows if k == key)
        for (v, n), following in zip(mine, [*(v for v, _ in mine[1:]), None], strict=True):
            total += n
            expected[key, v] = (total, following)
    assert found == expected
    everything = running_totals(df.select("n").distinct(), [], "n", ["n"], part_rows).collect()
    numbers = sorted({n for _, _, n in rows})
    assert sorted((r["n"], r["following"]) for r in everything if r["following"] is not None) == list(pairwise(numbers))
    assert running_totals(df.limit(0), ["k"], "v", ["n"], part_rows).collect() == []


def test_ranges_bound_what_a_task_orders(spark):
    for rows in (2_000, 20_000):
        df = spark.range(rows).select(F.lit("hot").alias("k"), F.col("id").alias("v"), F.lit(1).alias("n"))
        dealt = running_totals(df, ["k"], "v", ["n"], 500).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert running_totals(df, ["k"], "v", ["n"], 500).agg(F.max("n_upto")).first()[0] == rows
        assert len(dealt) > 1


@pytest.mark.parametrize("config", [MaskingConfig("data_swapping", swap_fraction=0.5), MaskingConfig("feature_perturbation", perturbation_strength=0.02)])
def test_distances_do_not_depend_on_ranges(spark, config):
    random.seed(3)
    spec = MaskSpec()
    df = people_rows(spark, [(30, "Male", 0)] * 3).limit(0)
    people = [(i, random.uniform(18, 90), random.choice(["Male", "Female"]), random.randrange(2), "HS-grad", "Sales") for i in range(600)]
    df = spark.createDataFrame(people, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("age:int", "age:double").replace(":", " ").replace(",", ", "))
    original, frame = wide(df, spec), evaluate_masks(df, spec, [config], TRIAL)
    before = moments(original_cube(original, spec), spec).drop("config_id")
    cube = masked_cube(frame, spec)
    bounds = drift.pooled_bounds(before, moments(cube, spec))
    points = drift.number_points(frame, spec, drift.spec_edges(original, spec, 8))
    hist = drift.histogram(points, bounds)
    expected = None
    for part_rows in (13, 100_000):
        found = {r["feature"]: (r["ks_statistic"], r["wasserstein_distance"]) for r in drift.distances(points, hist, part_rows).collect()}
        expected = expected or found
        assert found.keys() == expected.keys() and all(found[f] == pytest.approx(expected[f], abs=1e-12) for f in found)


def test_codes_of_texts_with_one_prefix(spark):
    texts = [f"Customer#{k:09d}" for k in range(300)] + ["", "é", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    codes = {r["text"]: r["code"] for r in text_codes(df, [], "text", "code", part_rows=20).collect()}
    assert codes == {t: i for i, t in enumerate(sorted(texts, key=str.encode))}


def test_long_summaries_are_not_broadcast(spark):
    """Their size as Spark guesses it would allow that."""
    df = spark.createDataFrame([(k, k) for k in range(50)], "k int, v int")
    plan = join_summary(df, df.select("k", (F.col("v") + 1).alias("s")), {"k": F.col("k")}, limit=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_summary_joins_broadcast_or_salt(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1), ("rare", 2), ("gone", 3)], "k string, v int")
    summary = spark.createDataFrame([("hot", 1.0), (None, 2.0), ("rare", 3.0)], "k string, s double")
    expected = sorted((str(k), v, {"hot": 1.0, None: 2.0, "rare": 3.0}.get(k)) for k, v in df.collect())
    for limit in (100, 2):
        joined = join_summary(df, summary, {"k": F.col("k")}, limit)
        assert joined.columns == ["k", "v", "s"] and sorted((str(r["k"]), r["v"], r["s"]) for r in joined.collect()) == expected
    plan = join_summary(df, summary, {"k": F.col("k")})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def brute_information(rows, k):
    """Ross's estimator, row against row."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    classes = {}
    for v, y in rows:
        classes.setdefault(y, []).append(v)
    kept = [(v, y) for v, y in rows if len(classes[y]) > 1]
    total = 0.0
    for v, y in kept:
        near = min(k, len(classes[y]) - 1)
        others = sorted(abs(u - v) for u in classes[y])[1:]
        r = others[near - 1]
        m = sum(v - r < u < v + r for u, _ in kept) if r > 0 else sum(u == v for u, _ in kept)
        total += psi(near) - psi(len(classes[y])) - psi(m)
    return max(psi(len(kept)) + total / len(kept), 0.0)


@pytest.mark.parametrize("part_rows", [5, 40, 100_000])
def test_nearest_information_equals_brute_force(spark, part_rows):
    random.seed(part_rows)
    rows = []
    for i in range(260):
        y = random.choice("aab")
        rows.append((y, random.gauss(2.0 if y == "a" else 0.0, 1.0), float(random.randrange(4)), 1.0 if i % 3 else float(i)))
    rows += [("lonely", 0.5, 1.0, 1.0), ("two", 9.0, 9.0, 9.0), ("two", 9.5, 9.0, 1.0)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), ("a", None, float("nan"), None)], "label string, x double, few double, hot double").repartition(5)
    found = {r["feature"]: r["mutual_information"] for r in nearest_information(df, {c: F.col(c) for c in ("x", "few", "hot")}, k=3, part_rows=part_rows).collect()}
    expected = {name: brute_information([(r[i], r[0]) for r in rows], 3) for i, name in enumerate(("x", "few", "hot"), 1)}
    assert found == {name: pytest.approx(value, abs=1e-9) for name, value in expected.items()}
    assert expected["x"] > 0.1


def test_digamma(spark):
    known = {1: -0.5772156649015329, 2: 0.42278433509846714, 10: 2.251752589066721, 1000: 6.907255195648812}
    for x, value in known.items():
        assert math.isclose(spark.range(1).select(digamma(F.lit(float(x))).alias("d")).first()["d"], value, abs_tol=1e-12)


def test_rows_are_numbered_over_files(spark, tmp_path):
    for name, low, high in (("b", 0, 700), ("a", 700, 900), ("c", 900, 905)):
        spark.range(low, high, 1, 1).write.parquet(str(tmp_path / "t" / f"part={name}"))
    rows = read_numbered(spark, str(tmp_path / "t")).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(905))
    by_id = [r["id"] for r in sorted(rows, key=lambda r: r["row_id"])]
    assert by_id == [*range(700, 900), *range(700), *range(900, 905)]
    assert not any(c.startswith("__") for c in rows[0].asDict())


def test_original_values_are_counted_once_for_all_settings(spark, monkeypatch):
    """Drift makes points of the masked side of each setting's rows only; the distances stay those of all points."""
    spec = MaskSpec()
    df = people_rows(spark, [(18 + i % 30, "Male" if i % 3 else "Female", i % 2) for i in range(600)])
    configs = [MaskingConfig("noise", noise_std=3.0), MaskingConfig("data_swapping", swap_fraction=0.5)]
    original, frame = wide(df, spec), evaluate_masks(df, spec, configs, TRIAL)
    edges = drift.spec_edges(original, spec, 8)
    assert drift.original_points(original, spec, edges).count() == 30 + 2
    made, distances = [], drift.distances

    def kept(points, hist):
        made.append(points)
        return distances(points, hist)

    monkeypatch.setattr(drift, "distances", kept)
    columns = ["config_id", "feature", "ks_statistic", "kl_divergence", "wasserstein_distance"]
    found = sorted(drift.drift_table(original, frame, spec, edges).select(columns).collect())
    assert made[0].count() == 2 * (600 * 2 + 30 + 2)
    points = drift.number_points(frame, spec, edges)
    assert points.count() == 2 * 600 * 4
    hist = drift.histogram(points, drift.pooled_bounds(moments(original_cube(original, spec), spec).drop("config_id"), moments(masked_cube(frame, spec), spec)))
    for row in distances(points, hist).collect():
        same = next(r for r in found if (r["config_id"], r["feature"]) == (row["config_id"], row["feature"]))
        assert tuple(same)[2::2] == pytest.approx((row["ks_statistic"], row["wasserstein_distance"]), abs=1e-12)
