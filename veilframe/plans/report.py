"""Report tables: what the charts of a run show, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Metrics of each report and the names of the two data sets.
SCORE_METRICS = ("privacy_score", "utility_score", "objective_score")
MODEL_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
STAGE_METRICS = ("train_accuracy", "validation_accuracy", "accuracy", "cv_accuracy_mean")
DRIFT_METRICS = ("ks_statistic", "kl_divergence", "variance_preservation")
ORIGINAL, BEST_MASKED = "Original", "Best Masked"
CHART_TOP, PRINTED_TOP = 8, 5
SUMMARY_COLUMNS = (
    "method", "noise_std", "generalization_bin", "epsilon", "hybrid_dp_budget_fraction", "swap_fraction",
    "perturbation_strength", "optimizer", "privacy_score", "privacy_loss", "utility_score", "objective_score",
    "k_anonymity", "reidentification_risk", "attribute_disclosure_risk", "information_leakage",
    "overfitting_rate", "underfitting_rate", "memorization_risk_rate",
)
PRINTED_COLUMNS = (
    "method", "noise_std", "generalization_bin", "epsilon", "swap_fraction", "perturbation_strength",
    "privacy_score", "privacy_loss", "utility_score", "objective_score", "accuracy_drop", "roc_auc_drop",
)
PLACES = 4


def top_settings(results: DataFrame, k: int = CHART_TOP) -> DataFrame:
    """The k best settings with their place (``#1`` first); the window runs over k rows."""
    best = results.orderBy(F.desc("objective_score"), "config_id").limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("objective_score"), "config_id")
    return best.withColumn("rank", F.concat(F.lit("#"), F.row_number().over(order).cast("string")))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], value: str = "score") -> DataFrame:
    """One row per metric; metrics that are absent are skipped."""
    present = [m for m in metrics if m in df.columns]
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in present]).unpivot(
        list(ids), present, "metric", value
    )


def setting_scores(results: DataFrame, k: int = CHART_TOP) -> DataFrame:
    return unpivot_metrics(top_settings(results, k), ["rank", "method"], SCORE_METRICS)


def both_datasets(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Model rows of both data sets under one roof."""
    return original.withColumn("dataset", F.lit(ORIGINAL)).unionByName(masked.withColumn("dataset", F.lit(BEST_MASKED)))


def model_comparison(original: DataFrame, masked: DataFrame, metrics: Sequence[str] = MODEL_METRICS) -> DataFrame:
    return unpivot_metrics(both_datasets(original, masked), ["dataset", "model"], metrics)


def stage_accuracies(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Train, validation, test and cross-validated accuracy per model and data set."""
    return model_comparison(original, masked, STAGE_METRICS)


def mean_scores(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bar heights: mean score per group."""
    return comparison.groupBy(*by).agg(F.avg("score").alias("score"))


def loss_by_method(results: DataFrame) -> DataFrame:
    """Five-number summary of the information loss per method."""
    loss = F.col("information_loss")
    return results.groupBy("method").agg(
        F.count(F.lit(1)).alias("settings"),
        F.min(loss).alias("lowest"),
        F.percentile(loss, 0.25).alias("lower_quartile"),
        F.percentile(loss, 0.5).alias("median"),
        F.percentile(loss, 0.75).alias("upper_quartile"),
        F.max(loss).alias("highest"),
    )


def drift_metrics(drift: DataFrame) -> DataFrame:
    return unpivot_metrics(drift, ["feature"], DRIFT_METRICS, "value")


def tradeoff(results: DataFrame) -> DataFrame:
    """Privacy and utility of every setting with the best one flagged."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("objective_score"), "config_id")  # one row per setting
    return results.select(
        "config_id", "method", "utility_score", "privacy_score", "objective_score",
        (F.row_number().over(order) == 1).alias("best"),
    )


def run_summary(results: DataFrame, places: int = PLACES) -> DataFrame:
    """The winning setting and its scores, rounded for reading."""
    numeric = {name for name, kind in results.dtypes if kind == "double"}
    best = results.orderBy(F.desc("objective_score"), "config_id").limit(1)
    return best.select(*[F.round(c, places).alias(c) if c in numeric else F.col(c) for c in SUMMARY_COLUMNS])


def printed_settings(results: DataFrame, k: int = PRINTED_TOP, places: int = PLACES) -> DataFrame:
    numeric = {name for name, kind in results.dtypes if kind == "double"}
    top = top_settings(results, k)
    return top.select("rank", *[F.round(c, places).alias(c) if c in numeric else F.col(c) for c in PRINTED_COLUMNS])
