"""What masking costs: preservation of structure, information loss, utility and objective."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import clip01, safe_ratio
from veilframe.operators.moments import matrices_long, moments_long, moments_wide
from veilframe.session import settle
from veilframe.spec import MaskSpec

# Weights of the utility score, of the generalisation penalty and of the objective.
UTILITY_WEIGHTS = {
    "accuracy_retention": 0.25,
    "auc_retention": 0.15,
    "correlation_preservation": 0.18,
    "covariance_preservation": 0.12,
    "statistical_similarity": 0.15,
    "generalization_quality": 0.10,
    "information_kept": 0.05,
}
GAP_LIMIT, CV_STD_LIMIT = 0.2, 0.08
PENALTY_WEIGHTS = {"gap": 0.45, "cv_std": 0.20, "overfitting": 0.20, "underfitting": 0.15}
BALANCE_SHARE = 0.10
DEFAULT_PRIVACY_WEIGHT = 0.50
SMALLEST_SCALE = 1e-9

UTILITY_COLUMNS = (
    "baseline_accuracy",
    "masked_accuracy",
    "baseline_roc_auc",
    "masked_roc_auc",
    "accuracy_drop",
    "roc_auc_drop",
    "information_loss",
    "correlation_preservation",
    "covariance_preservation",
    "statistical_similarity",
    "generalization_quality",
    "utility_score",
    "utility_loss",
)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def matrix_preservation(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """Closeness of the upper triangles of two long matrices, per setting."""
    old = before.select("feature_a", "feature_b", F.col(value).alias("old"))
    pairs = after.where(F.col("feature_a") < F.col("feature_b")).join(old, ["feature_a", "feature_b"])
    scale = F.greatest(F.avg(F.abs("old")), F.lit(SMALLEST_SCALE))
    kept = clip01(F.lit(1.0) - F.avg(F.abs(F.col("old") - F.col(value))) / scale)
    return pairs.groupBy("config_id").agg(kept.alias(f"{value}_preservation"))


def statistical_similarity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean over features of exp(-(mean gap + deviation gap) / 2), gaps in original deviations."""
    old = before.select("feature", F.col("mean").alias("old_mean"), F.col("std_pop").alias("old_std"))
    scale = F.greatest(F.col("old_std"), F.lit(SMALLEST_SCALE))
    gaps = (F.abs(F.col("old_mean") - F.col("mean")) + F.abs(F.col("old_std") - F.col("std_pop"))) / scale
    return (
        after.join(old, "feature")
        .groupBy("config_id")
        .agg(clip01(F.avg(F.exp(-gaps / F.lit(2.0)))).alias("statistical_similarity"))
    )


def information_loss(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """Mean over features and texts of the normalised distance or the share of changed cells.

    Text columns count twice: by the distance of their codes and by changed cells. Carried
    texts never change, so both of their terms are 0, but they still count in the mean.
    """
    rows = F.sum("n")

    def distance(gap: Column, low: Column, high: Column) -> Column:
        return F.sum(F.col("n") * gap) / rows / F.greatest(high - low, F.lit(SMALLEST_SCALE))

    new_code, old_code = F.col(f"{spec.category}_code"), F.col("old_code")
    terms = [
        distance(F.col("number_gap"), F.min("old_number_min"), F.max("old_number_max")),
        distance(F.col("flag_gap"), F.min("old_flag_min"), F.max("old_flag_max")),
        distance(F.abs(old_code - new_code), F.min(old_code), F.max(old_code)),
        F.sum(F.when(F.col("old_category") != F.col(spec.category), F.col("n")).otherwise(F.lit(0))) / rows,
    ]
    count = len(spec.features) + len(spec.texts)
    return cube.groupBy("config_id").agg(
        clip01(_sum(terms) / F.lit(float(count))).alias("information_loss")
    )


def fidelity(original: DataFrame, masked: DataFrame, spec: MaskSpec) -> DataFrame:
    """Preservation measures per setting from the two cubes."""
    before, after = settle(moments_wide(original, spec)), settle(moments_wide(masked, spec))
    old_matrix, new_matrix = matrices_long(before, spec).drop("config_id"), matrices_long(after, spec)
    similar = statistical_similarity(moments_long(before, spec).drop("config_id"), moments_long(after, spec))
    return (
        matrix_preservation(old_matrix, new_matrix, "correlation")
        .join(matrix_preservation(old_matrix, new_matrix, "covariance"), "config_id")
        .join(similar, "config_id")
        .join(information_loss(masked, spec), "config_id")
    )


def generalization_quality(gap: Column, cv_std: Column, overfitting: Column, underfitting: Column) -> Column:
    penalty = _sum(
        [
            F.lit(PENALTY_WEIGHTS["gap"]) * F.least(gap / F.lit(GAP_LIMIT), F.lit(1.0)),
            F.lit(PENALTY_WEIGHTS["cv_std"]) * F.least(cv_std / F.lit(CV_STD_LIMIT), F.lit(1.0)),
            F.lit(PENALTY_WEIGHTS["overfitting"]) * overfitting,
            F.lit(PENALTY_WEIGHTS["underfitting"]) * underfitting,
        ]
    )
    return clip01(F.lit(1.0) - penalty)


def model_summary(models: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the models, one row per setting; ROC-AUC falls back to accuracy."""
    has = set(models.columns)
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)) if c in has else F.lit(0.0)
    return models.groupBy(*keys).agg(
        F.avg("accuracy").alias("masked_accuracy"),
        F.avg("roc_auc" if "roc_auc" in has else "accuracy").alias("masked_roc_auc"),
        generalization_quality(
            mean("train_validation_gap"), mean("cv_accuracy_std"), mean("overfitting_flag"), mean("underfitting_flag")
        ).alias("generalization_quality"),
        mean("overfitting_flag").alias("overfitting_rate"),
        mean("underfitting_flag").alias("underfitting_rate"),
        mean("memorization_risk_flag").alias("memorization_risk_rate"),
    )


def baseline_summary(models: DataFrame) -> tuple[float, float]:
    """Mean accuracy and ROC-AUC of the baseline models (a handful of rows)."""
    auc = "roc_auc" if "roc_auc" in models.columns else "accuracy"
    row = models.agg(F.avg("accuracy").alias("accuracy"), F.avg(auc).alias("auc")).first()
    return float(row["accuracy"] or 0.0), float(row["auc"] or 0.0)


def utility_metrics(fidelity_rows: DataFrame, models: DataFrame, baseline: tuple[float, float]) -> DataFrame:
    """Utility of every setting from its preservation measures and its model summary."""
    accuracy, auc = (F.lit(float(v)) for v in baseline)
    joined = fidelity_rows.join(models, "config_id").withColumns(
        {"baseline_accuracy": accuracy, "baseline_roc_auc": auc}
    )
    retention = lambda new, old: F.least(safe_ratio(F.col(new), F.col(old)), F.lit(1.0))
    parts = {
        "accuracy_retention": retention("masked_accuracy", "baseline_accuracy"),
        "auc_retention": retention("masked_roc_auc", "baseline_roc_auc"),
        "correlation_preservation": F.col("correlation_preservation"),
        "covariance_preservation": F.col("covariance_preservation"),
        "statistical_similarity": F.col("statistical_similarity"),
        "generalization_quality": F.col("generalization_quality"),
        "information_kept": F.lit(1.0) - F.col("information_loss"),
    }
    score = clip01(_sum([F.lit(w) * parts[name] for name, w in UTILITY_WEIGHTS.items()]))
    return joined.withColumns(
        {
            "accuracy_drop": F.greatest(F.lit(0.0), F.col("baseline_accuracy") - F.col("masked_accuracy")),
            "roc_auc_drop": F.greatest(F.lit(0.0), F.col("baseline_roc_auc") - F.col("masked_roc_auc")),
            "utility_score": score,
        }
    ).withColumn("utility_loss", F.lit(1.0) - F.col("utility_score"))


def objective(privacy: Column, utility: Column, privacy_weight: float = DEFAULT_PRIVACY_WEIGHT) -> Column:
    """Utility minus privacy loss plus a bonus for balance; the weight scales only the bonus."""
    bonus = F.lit(1.0) - F.abs(privacy - utility)
    return utility - (F.lit(1.0) - privacy) + F.lit(privacy_weight * BALANCE_SHARE) * bonus
