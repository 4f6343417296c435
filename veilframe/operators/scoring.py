"""Quality of predicted probabilities: confusion counts, losses, ROC-AUC, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import clip, safe_ratio
from veilframe.operators.ranking import BUCKET_ROWS, running_totals

# Limits of the generalisation checks.
OVERFIT_GAP, OVERFIT_SHARE, UNDERFIT_ACCURACY, SIGNAL_LIMIT = 0.10, 0.92, 0.62, 0.65
PROBABILITY_FLOOR = 1e-6
CONSTANT_STD = 1e-9


def log_loss_term(y: Column, p: Column) -> Column:
    q = clip(p, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def classifier_metrics(df: DataFrame, keys: Sequence[str] = (), y="y", p="p", predicted="predicted") -> DataFrame:
    """Accuracy, precision, recall, F1, RMSE of the predicted classes and log loss, in one pass."""
    truth, guess = F.col(y).cast("double"), F.col(predicted).cast("double")
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((truth == 1) & (guess == 1)).alias("__tp"),
        F.count_if((truth == 0) & (guess == 1)).alias("__fp"),
        F.count_if((truth == 1) & (guess == 0)).alias("__fn"),
        F.count_if((truth == 0) & (guess == 0)).alias("__tn"),
        F.avg(log_loss_term(truth, F.col(p))).alias("log_loss"),
    )
    accuracy = safe_ratio(F.col("__tp") + F.col("__tn"), F.col("rows"))
    precision = safe_ratio(F.col("__tp"), F.col("__tp") + F.col("__fp"))
    recall = safe_ratio(F.col("__tp"), F.col("__tp") + F.col("__fn"))
    f1 = safe_ratio(F.col("__tp") * 2, F.col("__tp") * 2 + F.col("__fp") + F.col("__fn"))
    return counts.select(
        *keys,
        "rows",
        accuracy.alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.sqrt(F.lit(1.0) - accuracy).alias("rmse"),
        F.coalesce(F.col("log_loss"), F.lit(0.0)).alias("log_loss"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str] = (), y="y", p="p", part_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact ROC-AUC: for each negative, the positives scored above it and half of the tied ones.

    Equal scores collapse map-side. Distinct scores are walked in order by ranges of about
    ``part_rows``, so no task orders all scores of a group. A missing score counts as the highest.
    """
    score = F.coalesce(F.col(p).cast("double"), F.lit(float("nan")))
    per_score = df.groupBy(*keys, score.alias("__p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    ranked = running_totals(per_score, keys, "__p", ["pos"], part_rows)
    # A negative at rank r meets (all positives - those up to r) above it and pos at its own score.
    lost = F.sum(F.col("neg") * (F.col("pos_upto") - F.lit(0.5) * F.col("pos")))
    positives, negatives = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(safe_ratio(positives * negatives - lost, positives * negatives).alias("roc_auc"))


def sensitive_signal(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), p="p") -> DataFrame:
    """Largest absolute correlation of the probability with a sensitive column; constants are skipped."""

    def strength(column: str) -> Column:
        value, score = F.col(column).cast("double"), F.col(p).cast("double")
        spread_value, spread_score = F.stddev_pop(value), F.stddev_pop(score)
        usable = (spread_value > CONSTANT_STD) & (spread_score > CONSTANT_STD)
        ratio = F.try_divide(F.covar_pop(value, score), spread_value * spread_score)
        return F.coalesce(F.when(usable, F.abs(ratio)), F.lit(0.0))

    signals = [strength(c) for c in columns]
    largest = F.greatest(*signals) if len(signals) > 1 else (signals[0] if signals else F.lit(0.0))
    return df.groupBy(*keys).agg(largest.alias("sensitive_signal_correlation"))


def generalization_flags(train: Column, validation: Column, signal: Column) -> dict[str, Column]:
    gap = F.greatest(F.lit(0.0), train - validation)
    overfit = (gap > OVERFIT_GAP) & (validation < train * F.lit(OVERFIT_SHARE))
    return {
        "train_validation_gap": gap,
        "overfitting_flag": overfit,
        "underfitting_flag": (train < UNDERFIT_ACCURACY) & (validation < UNDERFIT_ACCURACY),
        "memorization_risk_flag": overfit | (signal > SIGNAL_LIMIT),
    }


def evaluation_rows(
    scored: DataFrame, keys: Sequence[str], sensitive: Sequence[str], y="y", p="p", predicted="predicted"
) -> DataFrame:
    """Report row per key from scored rows of the train, validation and test parts.

    Quality is that of the test part; a part without rows counts as all wrong.
    """
    per_part = classifier_metrics(scored, [*keys, "part"], y, p, predicted)

    def of(part: str, metric: str, missing: float = 0.0) -> Column:
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col(metric))), F.lit(missing))

    rows = per_part.groupBy(*keys).agg(
        *[of("test", m).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
        of("test", "rmse", 1.0).alias("rmse"),
        of("train", "accuracy").alias("train_accuracy"),
        of("validation", "accuracy").alias("validation_accuracy"),
        of("validation", "log_loss", 1.0).alias("validation_log_loss"),
        of("test", "log_loss", 1.0).alias("test_log_loss"),
    )
    test = scored.where(F.col("part") == "test")
    joined = rows.join(roc_auc(test, keys, y, p), list(keys), "left").join(
        sensitive_signal(test, sensitive, keys, p), list(keys), "left"
    )
    joined = joined.fillna(0.0, ["roc_auc", "sensitive_signal_correlation"])
    flags = generalization_flags(
        F.col("train_accuracy"), F.col("validation_accuracy"), F.col("sensitive_signal_correlation")
    )
    return joined.withColumns(flags)
