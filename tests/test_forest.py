"""The forest of grouped rows against MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from veilframe.operators import forest
from veilframe.operators.forest import GroupedForest

SETTINGS = dict(featuresCol="x", labelCol="label", weightCol="weight", maxDepth=5, seed=7)


@pytest.fixture(scope="module")
def many(spark):
    """4,000 rows of at most 160 kinds; no two values of the first column meet in a bin."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 20, 4000), rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)], axis=1).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(2.5 - x[:, 0] / 4 - x[:, 1] * x[:, 2]))).astype(float)
    rows = [(i, float(t), 1.5 if t else 0.75, r.tolist()) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, label double, weight double, v array<double>")
    return df.withColumn("x", array_to_vector("v")).repartition(3).persist()


@pytest.fixture(autouse=True)
def any_size(monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROWS", 1)


def scored(model, df):
    columns = ["label", "prediction", vector_to_array("probability")[1].alias("p")]
    return np.array([tuple(r) for r in model.transform(df).orderBy("row_id").select(*columns).collect()])


def refuse(*_):
    raise AssertionError("rows were passed one by one")


@pytest.mark.parametrize("least", [1, 60])
def test_trees_without_draws_equal_mllib(many, monkeypatch, least):
    whole = dict(SETTINGS, numTrees=2, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=least)
    expected = scored(RandomForestClassifier(**whole).fit(many), many)
    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    found = scored(GroupedForest(**whole).fit(many), many)
    assert found == pytest.approx(expected, abs=1e-9)


def test_bags_of_equal_rows(many, monkeypatch):
    """Equal rows are passed once, whatever the partitions; the forest agrees with MLlib's on average."""
    drawn = dict(SETTINGS, numTrees=40, featureSubsetStrategy="sqrt")
    expected = scored(RandomForestClassifier(**drawn).fit(many), many)
    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    passed, sums = [], forest.cell_sums
    monkeypatch.setattr(forest, "cell_sums", lambda groups, *rest: passed.append(groups.count()) or sums(groups, *rest))
    model = GroupedForest(**drawn).fit(many)
    found = scored(model, many)
    monkeypatch.setattr(forest, "GROUPS_PER_TASK", 9)
    again = scored(GroupedForest(**drawn).fit(many.repartition(7)), many)
    assert max(passed) <= 160 and found == pytest.approx(again, abs=1e-9)
    assert len({tuple(t.feature) for t in model.trees}) > 20
    assert np.abs(found[:, 2] - expected[:, 2]).mean() < 0.03
    assert np.mean(found[:, 1] == expected[:, 1]) > 0.95


def test_draws_are_those_of_single_rows():
    plan = forest.Plan(3, 1, 2, 1, 1, 1, 0.0, True, 1.0)
    times = np.concatenate([plan.draws(bytes([k]), 50, 100) for k in range(200)])
    assert times.mean() == pytest.approx(50, abs=0.2) and times.var() == pytest.approx(50, abs=1.5)


def test_different_rows_go_to_mllib(many):
    apart = many.withColumn("x", array_to_vector(F.array(F.rand(1), F.rand(2))))
    model = GroupedForest(**SETTINGS, numTrees=2).fit(apart)
    assert not isinstance(model, forest.GroupedForestModel)


def test_small_tables_go_to_mllib(many, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROWS", 4001)
    assert not isinstance(GroupedForest(**SETTINGS, numTrees=2).fit(many), forest.GroupedForestModel)


def test_table_without_a_split(many):
    """A tree that finds no split predicts its bag's share."""
    flat = many.withColumn("x", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    found = scored(GroupedForest(**SETTINGS, numTrees=30).fit(flat), flat)
    label, weight = np.array(many.select("label", "weight").collect()).T
    assert found[:, 2] == pytest.approx((label * weight).sum() / weight.sum(), abs=0.02)
