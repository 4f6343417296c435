"""Training, the sweep, reports, files and the whole run."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tests.rows import people_rows
from veilframe import Draws, MaskingConfig, MaskSpec
from veilframe.operators import models
from veilframe.operators.features import add_split
from veilframe.operators.masks import evaluate_masks
from veilframe.operators.models import MODEL_SCHEMA, ModelOptions, evaluate_models, unmasked
from veilframe.plans import candidates, report
from veilframe.plans.run import load, run
from veilframe.plans.sweep import RESULT_COLUMNS, SweepOptions, adaptive_sweep, best_config, best_release, sweep
from veilframe.sources.tables import first_existing, read_csv, read_people
from veilframe.spec import CONFIG_SCHEMA, config_frame

SPEC = MaskSpec()
GENERAL = MaskingConfig("generalization", generalization_bin=20)
NOISE = MaskingConfig("noise", noise_std=3.0, gender_mask_probability=0.15)
TINY = dict(trees=10, rounds=5, fourier_features=32, svm_iterations=20, logistic_iterations=50, folds=2)
SCREEN = SweepOptions(models=None, privacy_weight=0.55)


@pytest.fixture(scope="module")
def tuned(crowd):
    return {r["model"]: r for r in evaluate_models(unmasked(crowd, SPEC), SPEC, ModelOptions(**TINY)).collect()}


def test_all_families_train_and_tune(tuned):
    assert set(tuned) == {"Logistic Regression", "Random Forest", "SVM", "XGBoost"}
    for row in tuned.values():
        assert 0.6 < row["roc_auc"] < 0.85 and 0.5 < row["accuracy"] <= 1
        assert row["rmse"] == pytest.approx((1 - row["accuracy"]) ** 0.5)
        p, r = row["precision"], row["recall"]
        assert row["f1"] == pytest.approx(2 * p * r / (p + r) if p + r else 0.0)
        assert row["train_validation_gap"] == pytest.approx(max(0, row["train_accuracy"] - row["validation_accuracy"]))
        assert row["cv_accuracy_std"] >= 0 and row["feature_count"] in (8, 13)
        assert json.loads(row["best_params"])["select__k"] in (8, "all")
    assert json.loads(tuned["Logistic Regression"]["best_params"])["model__C"] in (0.1, 1.0, 3.0)
    assert json.loads(tuned["XGBoost"]["best_params"])["model__learning_rate"] in (0.05, 0.1)


def test_feature_counts_of_plain_and_binned_tables(crowd):
    quick = ModelOptions(models=("Logistic Regression",), tune=False, cross_validate=False)
    plain = evaluate_models(unmasked(crowd, SPEC), SPEC, quick).first()
    binned = evaluate_models(evaluate_masks(crowd, SPEC, [GENERAL]), SPEC, quick, binned=True).first()
    assert (plain["feature_count"], binned["feature_count"]) == (13, 17)
    assert binned["cv_accuracy_mean"] == binned["validation_accuracy"] and binned["cv_accuracy_std"] == 0


@pytest.mark.parametrize("rows", [[(40, "Male", 1)] * 30, [(40, "Male", i % 2) for i in range(10)]])
def test_nothing_to_learn_gives_guard_rows(spark, rows):
    found = evaluate_models(unmasked(people_rows(spark, rows), SPEC), SPEC).collect()
    assert len(found) == 4 and found[0].__fields__ == [f.name for f in MODEL_SCHEMA]
    assert all(r["rmse"] == 1 and r["underfitting_flag"] and r["best_params"] == "{}" for r in found)


# --- candidates ----------------------------------------------------------------------------------


def test_grid_and_default_candidates():
    grid = candidates.default_grid()
    assert len(grid) == 21 and sum(c.method == "hybrid" for c in grid) == 8
    assert grid[2].gender_mask_probability == 0.4 and grid[-1].gender_mask_probability == 0.3
    found = candidates.default_candidates()
    assert 40 <= len(found) <= 45 and len({c.label() for c in found}) == len(found)
    assert found == candidates.default_candidates()


def test_crossover_stays_inside_its_bounds():
    for child in candidates.crossover_search(5, 20, seed=3):
        if child not in candidates.crossover_search(0, 20, seed=3):
            for name, (low, high) in candidates.CROSSOVER_BOUNDS.items():
                assert low <= getattr(child, name) <= high


def test_adaptive_settings_are_new_and_in_range():
    parents = candidates.default_grid()[:5]
    known = {c.label() for c in candidates.default_grid()}
    found = candidates.adaptive_settings(parents, 40, known, seed=5)
    labels = {c.label() for c in found}
    assert len(labels) == 40 and not labels & known
    assert {c.method for c in found} > {c.method for c in parents}
    assert found == candidates.adaptive_settings(parents, 40, known, seed=5)
    for c in found:
        assert c.noise_std <= 12 and 0.2 <= c.epsilon <= 6 and c.swap_fraction <= 0.45 and c.perturbation_strength <= 0.45


def test_distinct_keeps_the_first():
    a, b = MaskingConfig("noise", noise_std=1.0), MaskingConfig("noise", noise_std=2.0)
    assert candidates.distinct([a, b, a]) == [a, b]
    assert candidates.canonical(MaskingConfig("noise", noise_std=1.0, epsilon=5.0)) == a


def test_config_frame(spark):
    frame = config_frame(spark, candidates.default_grid())
    assert frame.schema == CONFIG_SCHEMA and frame.count() == 21


# --- sweep -----------------------------------------------------------------------------------------


def test_chunks_do_not_change_the_sweep(crowd):
    configs = list(candidates.ANCHORS)
    one = sweep(crowd, SPEC, configs, SCREEN).toPandas()
    many = sweep(crowd, SPEC, configs, SweepOptions(models=None, privacy_weight=0.55, configs_per_job=2)).toPandas()
    assert list(one.columns) == list(RESULT_COLUMNS)
    assert one["config_id"].tolist() == many["config_id"].tolist()
    for column in ("privacy_score", "utility_score", "objective_score", "mean_kl_divergence"):
        assert one[column].to_numpy() == pytest.approx(many[column].to_numpy(), abs=1e-9)
    assert one["objective_score"].is_monotonic_decreasing


def test_trained_sweep_and_release(crowd):
    models = ModelOptions(models=("Logistic Regression",), tune=False, cross_validate=False, **TINY)
    results = sweep(crowd, SPEC, [NOISE, GENERAL], SweepOptions(models=models))
    rows = results.collect()
    assert all(0.5 < r["masked_accuracy"] < 1 and r["baseline_accuracy"] == rows[0]["baseline_accuracy"] for r in rows)
    table, config = best_release(crowd, SPEC, results, Draws())
    assert config == best_config(results) == GENERAL
    assert table.count() == 1500


def test_adaptive_rounds_add_new_settings(crowd):
    found = adaptive_sweep(crowd, SPEC, [NOISE, GENERAL], SCREEN, rounds=2, trials=4, parents=2).collect()
    assert {r["optimizer"] for r in found} == {"grid_random_genetic", "adaptive"}
    assert len({r["config_label"] for r in found}) == len(found) == len({r["config_id"] for r in found})


# --- reports, files, whole run -------------------------------------------------------------------


def test_reports(crowd):
    results = sweep(crowd, SPEC, [NOISE, GENERAL], SCREEN)
    assert [r["rank"] for r in report.top_settings(results, 1).collect()] == ["#1"]
    assert report.unpivot_metrics(results, ["method"], ["privacy_score", "absent"]).count() == 2
    assert [r["best"] for r in report.tradeoff(results).orderBy(F.desc("objective_score")).collect()] == [True, False]
    assert report.run_summary(results).first()["method"] == "generalization"
    assert report.printed_settings(results).count() == 2


def test_csv_reading(spark, tmp_path):
    (tmp_path / "adult_income.csv").write_text("age,sex,class,education,occupation\n30,Male,>50K,a,NA\n40,Female,<=50K,,c\n")
    raw = read_people(spark, str(tmp_path))
    assert [tuple(r) for r in raw.collect()] == [("30", "Male", ">50K", "a", None), ("40", "Female", "<=50K", None, "c")]
    assert read_csv(spark, str(tmp_path / "adult_income.csv")).count() == 2
    with pytest.raises(FileNotFoundError):
        first_existing(spark, [str(tmp_path / "nothing.csv")])


def test_repeated_keys_are_refused(spark, crowd, tmp_path):
    once, twice = str(tmp_path / "once.parquet"), str(tmp_path / "twice.parquet")
    keyed = crowd.select(F.col("row_id").alias("id"), *[F.col(c).alias(c.title()) for c in crowd.columns[1:]])
    keyed.write.parquet(once)
    keyed.unionByName(keyed.limit(1)).write.parquet(twice)
    assert load(spark, once, "id").count() == crowd.count()
    with pytest.raises(ValueError, match="id is not unique"):
        load(spark, twice, "id")


@pytest.mark.parametrize("masked_format", ["parquet", "csv"])
def test_whole_run(spark, crowd, tmp_path, masked_format):
    source = str(tmp_path / "people.csv")
    crowd.drop("row_id").coalesce(1).write.option("header", True).csv(source)
    table = load(spark, source, limit=1000)
    assert table.count() == 1000 and table.select("row_id").distinct().count() == 1000
    quick = ModelOptions(models=("Logistic Regression",), tune=False, cross_validate=False, **TINY)
    out = str(tmp_path / "out")
    options = SweepOptions(privacy_weight=0.55, models=quick)
    done = run(table, out, Draws("secret"), SPEC, options, quick, [NOISE, GENERAL], trials=2, masked_format=masked_format)
    assert done.masked.count() == 1000
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert {
        "original_mean", "original_variance", "original_covariance", "original_correlation", "original_ml_metrics",
        "optimization_results", "best_masked_dataset", "best_masked_mean", "best_masked_variance",
        "best_masked_covariance", "best_masked_correlation", "best_masked_ml_metrics", "statistical_validation",
        "privacy_utility_tradeoff", "top_config_scores", "model_metric_comparison", "generalization_diagnostics",
        "information_loss_by_method", "transformation_impact", "top_settings", "run_summary",
    } <= written
    drift = spark.read.option("header", True).csv(f"{out}/statistical_validation")
    assert drift.count() == 5


def test_machine_passes_equal_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (900, 2)).astype(float)
    y = (x[:, 0] + rng.normal(size=900) > 1).astype(float)
    rows = [(float(t), 1.5 if t else 0.75, r.tolist()) for t, r in zip(y, x, strict=True)]
    df = spark.createDataFrame(rows, "label double, weight double, x array<double>").withColumn("scaled", array_to_vector("x"))
    fourier = models.FourierFeatures("scaled", "fourier", 16, 1)
    fit, passed = models.LinearSVC._fit, []

    def counted(self, dataset):
        passed.append(dataset.count())
        return fit(self, dataset)

    monkeypatch.setattr(models.LinearSVC, "_fit", counted)
    found = []
    for kind in (models.FourierSVC, models.LinearSVC):
        machine = kind(featuresCol="fourier", labelCol="label", weightCol="weight", maxIter=60, regParam=0.01, standardization=False)
        machine.fourier = fourier
        fitted = machine.copy({machine.regParam: 0.02}).fit(fourier.transform(df))
        sides = fitted.transform(fourier.transform(df)).select("label", "weight", vector_to_array("rawPrediction")[1]).collect()
        t, w, margin = np.array(sides).T
        loss = (w * np.maximum(0, 1 - (2 * t - 1) * margin)).sum() / w.sum()
        found.append(loss + 0.02 / 2 * (fitted.coefficients.toArray() ** 2).sum())
    assert passed[0] <= 18 and passed[1] == 900
    assert found[0] == pytest.approx(found[1], rel=0.01)


def test_folds_are_drawn_only_where_they_are_read(crowd):
    for options, drawn in ((dict(tune=False, cross_validate=False), False), (dict(tune=True, cross_validate=False), True), (dict(tune=False), True)):
        data = models.prepare(unmasked(crowd, SPEC), SPEC, False, ModelOptions(**options))
        assert ("fold" in data.frame.columns) == drawn
        data.frame.unpersist()


def test_split_compares_digits_with_the_same_parts(spark):
    rows = spark.range(5000).withColumnRenamed("id", "row_id")
    for draws in (Draws(), Draws(3, "xxhash64")):
        u = draws.uniform("models", "split", F.col("row_id"))
        expected = F.when(u < 0.6, "train").when(u < 0.6 + 0.2, "validation").otherwise("test")
        found = add_split(rows, draws)
        assert found.where(F.col("part") != expected).count() == 0
        assert "conv(" not in found._jdf.queryExecution().optimizedPlan().toString()
