"""Design matrix, split, class weights and feature scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.functions.numeric import safe_ratio
from veilframe.operators.ranking import cut_points, up_to

# Shares of the train, validation and test parts.
TRAIN_SHARE, VALIDATION_SHARE = 0.60, 0.20
PARTS = ("train", "validation", "test")
SCORE_BINS = 20
GROUPED_SHARE = 8  # training rows are grouped if there are this many times as many as different ones


def design_model(df: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> PipelineModel:
    """One-hot texts next to plain numbers, columns in name order.

    Every real value keeps its own column; a missing or unseen text is all zeros.
    """
    indexer = StringIndexer(
        inputCols=list(texts), outputCols=[f"{c}__index" for c in texts],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    encoder = OneHotEncoder(
        inputCols=[f"{c}__index" for c in texts], outputCols=[f"{c}__hot" for c in texts], dropLast=True
    )
    parts = sorted([*numbers, *texts])
    assembler = VectorAssembler(
        inputCols=[f"{c}__hot" if c in texts else c for c in parts], outputCol="features", handleInvalid="keep"
    )
    stages = [indexer, encoder, assembler] if texts else [assembler]
    return Pipeline(stages=stages).fit(df)


def feature_names(model: PipelineModel, numbers: Sequence[str], texts: Sequence[str]) -> list[str]:
    """Names of the vector slots: a number's own name, or ``column_value``."""
    labels = dict(zip(texts, model.stages[0].labelsArray, strict=True)) if texts else {}
    names: list[str] = []
    for column in sorted([*numbers, *texts]):
        names += [f"{column}_{value}" for value in labels[column]] if column in labels else [column]
    return names


def add_split(df: DataFrame, draws: Draws, row_id: str = "row_id") -> DataFrame:
    """``part`` by a keyed draw: 60/20/20 in expectation within every label, no shuffle."""
    first, second = (draws.below("models", "split", F.col(row_id), s) for s in (TRAIN_SHARE, TRAIN_SHARE + VALIDATION_SHARE))
    return df.withColumn("part", F.when(first, PARTS[0]).when(second, PARTS[1]).otherwise(PARTS[2]))


def add_exact_split(df: DataFrame, draws: Draws, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """``part`` with exact shares within every label (half-even rounding of the cuts)."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    drawn = df.withColumn("__u", draws.uniform("models", "split", F.col(row_id)))
    limits = {
        value: (round(size * TRAIN_SHARE), round(size * (TRAIN_SHARE + VALIDATION_SHARE)))
        for value, size in sizes.items()
    }
    cuts = cut_points(drawn, label, "__u", row_id, limits, max(sizes.values(), default=0))

    def within(value: object, limit: int) -> Column:
        if limit < 1:
            return F.lit(False)
        cut_u, cut_id = cuts[(value, limit)]
        return up_to(F.col("__u"), F.col(row_id), F.lit(cut_u), F.lit(cut_id))

    part = F.lit(None).cast("string")
    for value, (first, second) in limits.items():
        choice = F.when(within(value, first), PARTS[0]).when(within(value, second), PARTS[1]).otherwise(PARTS[2])
        part = F.when(F.col(label) == F.lit(value), choice).otherwise(part)
    return drawn.withColumn("part", part).drop("__u")


def add_fold(df: DataFrame, draws: Draws, folds: int, row_id: str = "row_id") -> DataFrame:
    u = draws.uniform("models", "fold", F.col(row_id))
    return df.withColumn("fold", F.floor(u * F.lit(float(folds))).cast("int"))


def worth_grouping(df: DataFrame, *columns: str | Column) -> bool:
    """Whether rows that agree in ``columns`` are many enough to be made one row first."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*columns)).alias("different")).first()
    return found["rows"] >= GROUPED_SHARE * found["different"]


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight rows/(classes x class rows) per label."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy(F.lit(0))  # one row per label
    total, classes = F.sum("rows").over(everything), F.count(F.lit(1)).over(everything)
    return sizes.select(label, "rows", (total / (classes * F.col("rows"))).alias("weight"))


def number_bin(column: Column, low: float, high: float, bins: int = SCORE_BINS) -> Column:
    position = F.floor((column - F.lit(low)) / F.lit(high - low) * F.lit(float(bins)))
    return F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("bigint")


def mutual_information(
    df: DataFrame,
    texts: Sequence[str],
    numbers: Mapping[str, tuple[float, float]],
    label: str = "label",
) -> DataFrame:
    """Mutual information of each design column with the label, in nats.

    A text value is scored as its 0/1 column, a number by equal-width bins. One pass counts
    (column, value, label); the absent side of a 0/1 column is the rest of the label's rows.
    """
    items = [F.struct(F.lit(c).alias("source"), F.col(c).cast("string").alias("value")) for c in texts]
    items += [
        F.struct(F.lit(c).alias("source"), number_bin(F.col(c), *bounds).cast("string").alias("value"))
        for c, bounds in numbers.items()
    ]
    counts = (
        df.select(F.col(label).alias("y"), F.explode(F.array(*items)).alias("item"))
        .groupBy("item.source", "item.value", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    source = Window.partitionBy("source")
    joint = counts.withColumns(
        {
            "n_value": F.sum("n").over(Window.partitionBy("source", "value")),
            "n_label": F.sum("n").over(Window.partitionBy("source", "y")),
            "n_all": F.sum("n").over(source),
        }
    )

    def term(n: Column, n_value: Column) -> Column:
        share = n / F.col("n_all")
        ratio = F.try_divide(n.cast("double") * F.col("n_all"), n_value.cast("double") * F.col("n_label"))
        return F.when(n > 0, share * F.log(ratio)).otherwise(F.lit(0.0))

    # Each (value, label) cell adds its own term; for 0/1 columns also the cell of its absence.
    is_text = F.col("source").isin(*texts)
    present = term(F.col("n"), F.col("n_value"))
    absent = term(F.col("n_label") - F.col("n"), F.col("n_all") - F.col("n_value"))
    scored = joint.withColumn("feature", F.when(is_text, F.concat_ws("_", "source", "value")).otherwise(F.col("source")))
    by_feature = scored.groupBy("feature").agg(
        F.sum(present + F.when(is_text, absent).otherwise(F.lit(0.0))).alias("seen"),
        F.sum(F.when(is_text, F.col("n_label"))).alias("seen_labels"),
        F.max(F.when(is_text, F.col("n_value"))).alias("n_value"),
        F.max("n_all").alias("n_all"),
    )
    # A label that never meets the value has no counted cell: all its rows are on the absent
    # side, where they add (rows/all) * ln(all / absent rows).
    unseen = F.col("n_all") - F.col("seen_labels")
    rest = F.when(
        unseen > 0,
        safe_ratio(unseen, F.col("n_all")) * F.log(F.try_divide(F.col("n_all"), F.col("n_all") - F.col("n_value"))),
    )
    return by_feature.select("feature", (F.col("seen") + F.coalesce(rest, F.lit(0.0))).alias("mutual_information"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best features, names settling ties."""
    return scores.orderBy(F.desc("mutual_information"), "feature").limit(k)
