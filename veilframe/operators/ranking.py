"""Order statistics and row numbers without moving a table into one task.

An ordered window without partitions runs in a single task. Here the order column is cut
into buckets whose sizes are counted map-side; that settles all but one bucket per cut, and
only that bucket is ordered. What remains is a pair of numbers per cut, so picking exactly n
rows becomes a plain filter. ``running_totals`` is for the cases that need every row's place:
rows are dealt to tasks by range, and each range starts from the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import ensure_checkpoint_dir, settle

BUCKET_ROWS = 100_000
NARROWING = 1024  # parts that a pass of ``order_statistic`` cuts its interval into
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above the low 33 bits


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets of about ``bucket_rows`` rows, however many that makes."""
    return max(1, ceil(rows / max(bucket_rows, 1)))


def order_statistic(df: DataFrame, value: Column, rank: int) -> float | None:
    """The value with ``rank`` smaller or equal ones before it (from 0), nulls left out; None beyond the last.

    Each pass counts the values of an interval in equal parts, map-side, and goes on with the part
    that holds the rank, until that part holds one value. Nothing is sorted or shuffled but the
    counts, at any table size.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    found = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    low, high, before = found["low"], found["high"], 0
    if not 0 <= rank < found["n"]:
        return None
    while low < high:
        inside = values.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        share = (F.col("v") - F.lit(low)) / F.lit(high - low)
        part = F.greatest(F.least(F.floor(share * NARROWING), F.lit(NARROWING - 1)), F.lit(0))
        # The ends make parts of their own, so a pass always narrows the interval.
        part = F.when(F.col("v") == F.lit(low), -1).when(F.col("v") == F.lit(high), NARROWING).otherwise(part)
        parts = inside.groupBy(part.alias("part")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(parts.collect(), key=lambda row: row["part"]):
            if rank < before + row["n"]:
                low, high = row["low"], row["high"]
                break
            before += row["n"]
    return low


def exact_median(df: DataFrame, value: Column) -> float | None:
    """Middle value, or the mean of the two middle ones; None without values."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return None
    low = order_statistic(df, value, (n - 1) // 2)
    return low if n % 2 else (low + order_statistic(df, value, n // 2)) / 2


def smallest_mode(df: DataFrame, value: Column) -> float | None:
    """Most frequent value, of several the smallest; values are counted before they meet."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("v").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode")).first()["mode"]


def draw_bucket(draw: Column, buckets: int) -> Column:
    """Equal-width bucket of a uniform draw; draws are uniform, so buckets are even."""
    return F.floor(draw * F.lit(float(buckets))).cast("int")


def bucket_starts(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Size of each bucket and the rows before it: one row for each group and bucket."""
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], part_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Rows with ``<name>_upto`` for each of ``sums``, the total up to and with the row, and ``following``.

    Rows of the same ``keys`` are taken in the order of the column ``order``, which may not repeat in
    them; ``following`` is the next row's value of it. A task orders about ``part_rows`` rows, however
    many of them have the same keys: the rows are dealt by range, and one small row for each range
    and key carries totals, and the first value of the next range, across the borders.
    """
    kept = settle(df)
    parts = bucket_count(kept.count(), part_rows)
    whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    if parts == 1:
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return kept.select("*", *[F.sum(s).over(upto).alias(f"{s}_upto") for s in sums], F.lead(order).over(whole).alias("following"))
    # The ranges are drawn from a sample, so they are written before anything depends on them.
    dealt = settle(kept.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()))
    borders = dealt.groupBy(*keys, "__part").agg(*[F.sum(s).alias(f"__{s}") for s in sums], F.min(order).alias("__first"))
    by_part = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.col("__part").alias("__of_part"),
        *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums],
        F.lead("__first").over(by_part).alias("__next"),
    )
    inside = Window.partitionBy("__part", *keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", *[F.sum(s).over(upto).alias(f"__in_{s}") for s in sums], F.lead(order).over(inside).alias("__within"))
    same = [F.col("__part") == F.col("__of_part"), *[F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]]
    return placed.join(borders, same).select(
        *df.columns,
        *[(F.col(f"__in_{s}") + F.col(f"__before_{s}")).alias(f"{s}_upto") for s in sums],
        F.coalesce("__within", "__next").alias("following"),
    )


def cut_points(
    df: DataFrame,
    key: str,
    draw: str,
    tie: str,
    limits: Mapping[object, Sequence[int]],
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
) -> dict[tuple[object, int], tuple[float, object]]:
    """For each key and each limit n, the n-th smallest ``(draw, tie)`` of that key.

    ``rows`` is the size of the largest group. Limits outside 1..size have no entry.
    """
    asked = [(k, int(n)) for k, numbers in limits.items() for n in numbers if n >= 1]
    if not asked:
        return {}
    buckets = bucket_count(rows, bucket_rows)
    schema = f"`{key}` {dict(df.dtypes)[key]}, __limit bigint"
    wanted = df.sparkSession.createDataFrame(asked, schema)
    placed = df.select(key, draw, tie, draw_bucket(F.col(draw), buckets).alias("__bucket"))
    starts = bucket_starts(placed, [key], "__bucket")
    inside = (F.col("__limit") > F.col("__start")) & (F.col("__limit") <= F.col("__start") + F.col("__size"))
    hits = starts.join(F.broadcast(wanted), key).where(inside)
    hits = hits.select(key, "__bucket", "__limit", (F.col("__limit") - F.col("__start")).alias("__offset"))
    # hits: one row per asked limit, so both broadcasts are bounded by the number of cuts.
    near = placed.join(F.broadcast(hits.select(key, "__bucket").distinct()), [key, "__bucket"], "left_semi")
    order = Window.partitionBy(key, "__bucket").orderBy(draw, tie)
    numbered = near.withColumn("__offset", F.row_number().over(order).cast("bigint"))
    found = numbered.join(F.broadcast(hits), [key, "__bucket", "__offset"]).select(key, "__limit", draw, tie)
    return {(r[0], r[1]): (r[2], r[3]) for r in found.collect()}


def up_to(draw: Column, tie: Column, cut_draw: Column, cut_tie: Column) -> Column:
    """True for rows at or before a cut point."""
    return (draw < cut_draw) | ((draw == cut_draw) & (tie <= cut_tie))


def number_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 for a table without a key.

    The provisional ids depend on how the input was split, so they are checkpointed before
    use: a lost executor then re-reads the same numbers.
    """
    ensure_checkpoint_dir(df.sparkSession)
    marked = df.withColumn("__mark", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__mark", ROW_BITS)
    position = F.col("__mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = marked.withColumn("__part", part).withColumn("__position", position)
    starts = bucket_starts(numbered, [], "__part")
    return (
        numbered.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__position"))
        .drop("__mark", "__part", "__position", "__start")
    )
