"""Distribution drift between the original and the masked side of a wide frame.

Kolmogorov-Smirnov and Wasserstein compare two distribution functions over all pooled
values. Sorting every value of every setting would shuffle the whole table, so the work is
done in two passes:

1. Cut the values into buckets and keep counts and sums per bucket (combined map-side).
   At bucket ends both distribution functions are known exactly. Inside a bucket they can
   only lie between their end values. So most buckets are settled: they cannot hold the
   maximum, and their functions do not cross, which makes the integral a plain difference
   of sums.
2. Only rows of the unsettled buckets are grouped by value and walked in order, by ranges of
   a bounded number of values.

The result is exact for any bucket edges; edges only decide how much is left for pass 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.numeric import clip01, normal_p_value, safe_ratio
from veilframe.operators.moments import masked_cube, moments, original_cube
from veilframe.operators.ranking import BUCKET_ROWS, running_totals
from veilframe.session import settle
from veilframe.spec import MaskSpec

KL_BINS = 20
KL_FLOOR = 1e-9
DEFAULT_BUCKETS = 256
CELL = ["config_id", "feature"]


# --- bucket edges ------------------------------------------------------------------------


def bucket_edges(
    df: DataFrame, columns: Mapping[str, str], grid: Mapping[str, tuple[float, float]], buckets: int = DEFAULT_BUCKETS
) -> dict[str, list[float]]:
    """Quantiles of the data plus an even grid: at most ``3 x buckets`` numbers per feature.

    Quantiles keep buckets even where the data are dense, the grid where masking spreads them.
    A quantile that repeats marks a value with a large share of the rows; it gets a bucket of
    its own, which holds one value and is settled at once.
    """
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f) for f, c in columns.items()]
    ).first()
    edges = {}
    for feature in columns:
        low, high = grid[feature]
        even = [low + (high - low) * i / buckets for i in range(buckets + 1)]
        quantiles = [float(v) for v in (found[feature] or [])]
        heavy = [math.nextafter(a, math.inf) for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b]
        edges[feature] = sorted({*even, *quantiles, *heavy})
    return edges


def _with_buckets(df: DataFrame, edges: Mapping[str, list[float]], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``<column>__bucket`` by binary search over the edges."""
    inf = float("inf")
    bucketizer = Bucketizer(
        splitsArray=[[-inf, *edges[feature], inf] for feature, _ in columns],
        inputCols=[column for _, column in columns],
        outputCols=[f"{column}__bucket" for _, column in columns],
        handleInvalid="keep",
    )
    return bucketizer.transform(df)


# --- points ------------------------------------------------------------------------------


def _side_points(df: DataFrame, spec: MaskSpec, edges: Mapping[str, list[float]], side: str, keys: Sequence[str]) -> DataFrame:
    """The two numbers of one side (``o`` or ``m``) as (keys, feature, bucket, value)."""
    columns = [(c, f"{side}_{c}") for c in spec.numbers]
    filled = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for _, c in columns])
    points = [
        F.struct(F.lit(feature).alias("feature"), F.col(f"{c}__bucket").cast("int").alias("bucket"), F.col(c).alias("value"))
        for feature, c in columns
    ]
    return _with_buckets(filled, edges, columns).select(*keys, F.explode(F.array(*points)).alias("p")).select(*keys, "p.*")


def original_points(original: DataFrame, spec: MaskSpec, edges: Mapping[str, list[float]]) -> DataFrame:
    """How often the original side has each value: (feature, bucket, value, originals); the same for every setting."""
    places = ["feature", "bucket", "value"]
    return settle(_side_points(original, spec, edges, "o", []).groupBy(*places).agg(F.count(F.lit(1)).alias("a")))


def number_points(frame: DataFrame, spec: MaskSpec, edges: Mapping[str, list[float]], originals: DataFrame | None = None) -> DataFrame:
    """Both sides of the two numbers as (setting, feature, bucket, value, originals, masked).

    ``originals`` are values of the original side with their counts for every setting; without them
    each setting's rows are taken once more.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    before = _side_points(frame, spec, edges, "o", ["config_id"]).withColumn("a", one) if originals is None else originals
    masked = _side_points(frame, spec, edges, "m", ["config_id"])
    return masked.select("*", none.alias("a"), one.alias("b")).unionByName(before.withColumn("b", none))


def code_points(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """Category codes of both sides, every code a bucket of its own.

    The masked cube holds both sides: the old category next to the new one, and the carried
    categories, which masking never changes.
    """

    def point(name: str, code: str, a: str | None, b: str | None) -> Column:
        return F.struct(
            F.lit(f"{name}_code").alias("feature"),
            F.col(code).cast("int").alias("bucket"),
            F.col(code).alias("value"),
            (F.col(a) if a else F.lit(0)).cast("bigint").alias("a"),
            (F.col(b) if b else F.lit(0)).cast("bigint").alias("b"),
        )

    points = [
        point(spec.category, "old_code", "n", None),
        point(spec.category, f"{spec.category}_code", None, "n"),
        *[point(c, f"{c}_code", "n", "n") for c in spec.carried],
    ]
    return cube.select("config_id", F.explode(F.array(*points)).alias("p")).select("config_id", "p.*")


def kl_bin(value: Column, low: Column, high: Column, bins: int = KL_BINS) -> Column:
    """Equal-width bin over low..high, last bin closed, settled against the exact edges."""
    step = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((value - low) / (high - low) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    edge = lambda i: i.cast("double") * step + low
    below = value < edge(guess)
    above = (value >= edge(guess + 1)) & (guess < bins - 1)
    moved = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when(high > low, moved).otherwise(F.lit(0))


# --- histogram and its reading -------------------------------------------------------------


def pooled_bounds(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pooled minimum and maximum per setting and feature, from the moments of both sides."""
    old = before.select("feature", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
    return after.join(old, "feature").select(
        *CELL, F.least("low", "old_low").alias("pooled_low"), F.greatest("high", "old_high").alias("pooled_high")
    )


def histogram(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Counts, sums and bounds per bucket and divergence bin; one row per cell of the grid."""
    # bounds: one row per setting and feature.
    binned = points.join(F.broadcast(bounds), CELL).withColumn(
        "kl_bin", kl_bin(F.col("value"), F.col("pooled_low"), F.col("pooled_high"))
    )
    return binned.groupBy(*CELL, "bucket", "kl_bin").agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.sum(F.col("a") * F.col("value")).alias("s_a"),
        F.sum(F.col("b") * F.col("value")).alias("s_b"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
    )


def kl_divergence(hist: DataFrame, bounds: DataFrame, bins: int = KL_BINS) -> DataFrame:
    """Divergence of the masked from the original density over equal bins.

    Both densities sum to the same total, so bins that are empty on both sides add nothing.
    """
    per_bin = hist.groupBy(*CELL, "kl_bin").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    cell = Window.partitionBy(*CELL)
    width = (F.col("pooled_high") - F.col("pooled_low")) / F.lit(float(bins))
    whole = F.lit(1.0) / width + F.lit(bins * KL_FLOOR)

    def density(n: str) -> Column:
        return (F.col(n) / F.sum(n).over(cell) / width + F.lit(KL_FLOOR)) / whole

    varies = F.col("pooled_low") < F.col("pooled_high")
    terms = per_bin.join(F.broadcast(bounds), CELL).where(varies)
    terms = terms.withColumn("p", density("n_a")).withColumn("q", density("n_b"))
    return terms.groupBy(*CELL).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl_divergence"))


def bucket_ends(hist: DataFrame) -> DataFrame:
    """Both distribution functions at the bucket ends, and which buckets are settled."""
    merged = hist.groupBy(*CELL, "bucket").agg(
        *[F.sum(c).alias(c) for c in ("n_a", "n_b", "s_a", "s_b")],
        F.min("first_value").alias("first_value"),
        F.max("last_value").alias("last_value"),
    )
    order = Window.partitionBy(*CELL).orderBy("bucket")
    cell = Window.partitionBy(*CELL)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = merged.select(
        "*",
        F.sum("n_a").over(running).alias("upto_a"),
        F.sum("n_b").over(running).alias("upto_b"),
        F.sum("n_a").over(cell).alias("all_a"),
        F.sum("n_b").over(cell).alias("all_b"),
        F.coalesce(F.lead("first_value").over(order), F.col("last_value")).alias("next_value"),
    ).withColumns(
        {
            "f_a": F.col("upto_a") / F.col("all_a"),
            "f_b": F.col("upto_b") / F.col("all_b"),
            "before_a": (F.col("upto_a") - F.col("n_a")) / F.col("all_a"),
            "before_b": (F.col("upto_b") - F.col("n_b")) / F.col("all_b"),
        }
    )
    ends = ends.withColumn("gap", F.abs(F.col("f_a") - F.col("f_b")))
    ends = ends.withColumn("largest", F.max("gap").over(cell))
    reach = F.greatest(F.abs(F.col("before_a") - F.col("f_b")), F.abs(F.col("f_a") - F.col("before_b")))
    one_sided = (F.col("before_a") >= F.col("f_b")) | (F.col("f_a") <= F.col("before_b"))
    many_values = F.col("first_value") < F.col("last_value")
    width = F.col("next_value") - F.col("first_value")
    area = (
        (F.col("before_a") - F.col("before_b")) * width
        + (F.col("n_a") * F.col("next_value") - F.col("s_a")) / F.col("all_a")
        - (F.col("n_b") * F.col("next_value") - F.col("s_b")) / F.col("all_b")
    )
    return ends.withColumns(
        {"unsettled": many_values & ((reach > F.col("largest")) | ~one_sided), "area": F.abs(area)}
    )


def walk_unsettled(points: DataFrame, ends: DataFrame, part_rows: int = BUCKET_ROWS) -> DataFrame:
    """Largest gap and exact area inside the unsettled buckets.

    A light mask leaves most buckets of a continuous column unsettled, and a bucket grows with the
    table. So values are not ordered by bucket but by range, about ``part_rows`` to a task.
    """
    wanted = ends.where("unsettled").select(
        *CELL, "bucket", "all_a", "all_b", "next_value",
        (F.col("upto_a") - F.col("n_a")).alias("start_a"), (F.col("upto_b") - F.col("n_b")).alias("start_b"),
    )
    # wanted: a subset of the bucket grid, so its size is bounded by settings x features x edges.
    rows = points.join(F.broadcast(wanted.select(*CELL, "bucket")), [*CELL, "bucket"], "left_semi")
    per_value = rows.groupBy(*CELL, "bucket", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    stepped = running_totals(per_value, [*CELL, "bucket"], "value", ["a", "b"], part_rows)
    stepped = stepped.join(F.broadcast(wanted), [*CELL, "bucket"])
    gap = F.abs(
        (F.col("start_a") + F.col("a_upto")) / F.col("all_a") - (F.col("start_b") + F.col("b_upto")) / F.col("all_b")
    )
    step = F.coalesce(F.col("following"), F.col("next_value")) - F.col("value")
    return stepped.groupBy(*CELL).agg(F.max(gap).alias("inside_gap"), F.sum(gap * step).alias("inside_area"))


def distances(points: DataFrame, hist: DataFrame, part_rows: int = BUCKET_ROWS, ends: DataFrame | None = None) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 distance per setting and feature.

    ``ends`` are the ``bucket_ends`` of the histogram if they are known; ``points`` then need only hold
    the values of unsettled buckets.
    """
    ends = settle(bucket_ends(hist)) if ends is None else ends
    settled = ends.groupBy(*CELL).agg(
        F.max("gap").alias("end_gap"), F.sum(F.when(~F.col("unsettled"), F.col("area"))).alias("settled_area")
    )
    inside = walk_unsettled(points, ends, part_rows)
    return settled.join(inside, CELL, "left").select(
        *CELL,
        F.greatest(F.col("end_gap"), F.coalesce(F.col("inside_gap"), F.lit(0.0))).alias("ks_statistic"),
        (F.coalesce(F.col("settled_area"), F.lit(0.0)) + F.coalesce(F.col("inside_area"), F.lit(0.0))).alias(
            "wasserstein_distance"
        ),
    )


# --- moment statistics ---------------------------------------------------------------------


def variance_preservation(before: Column, after: Column) -> Column:
    return clip01(F.lit(1.0) - F.abs(before - after) / F.greatest(F.abs(before), F.lit(1e-9)))


def welch_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    return safe_ratio(mean_a - mean_b, F.sqrt(var_a / n_a + var_b / n_b))


def moment_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Welch t, its p value, variances, their preservation and the mean shift."""
    old = before.select(
        "feature", F.col("n").alias("old_n"), F.col("mean").alias("old_mean"), F.col("variance").alias("old_variance")
    )
    t = welch_t(
        F.col("old_mean"), F.col("old_variance"), F.col("old_n"), F.col("mean"), F.col("variance"), F.col("n")
    )
    return (
        after.join(old, "feature")
        .withColumn("t_statistic", t)
        .select(
            *CELL,
            "t_statistic",
            normal_p_value(F.col("t_statistic")).alias("approximate_p_value"),
            F.col("old_variance").alias("original_variance"),
            F.col("variance").alias("masked_variance"),
            variance_preservation(F.col("old_variance"), F.col("variance")).alias("variance_preservation"),
            (F.col("mean") - F.col("old_mean")).alias("mean_shift"),
        )
    )


def spec_grid(spec: MaskSpec) -> dict[str, tuple[float, float]]:
    return {spec.numeric: (spec.lower, spec.upper), spec.flag: (0.0, 1.0)}


def spec_edges(original: DataFrame, spec: MaskSpec, buckets: int = DEFAULT_BUCKETS) -> dict[str, list[float]]:
    return bucket_edges(original, {c: f"o_{c}" for c in spec.numbers}, spec_grid(spec), buckets)


def drift_table(
    original: DataFrame,
    frame: DataFrame,
    spec: MaskSpec,
    edges: Mapping[str, list[float]] | None = None,
    cubes: tuple[DataFrame, DataFrame] | None = None,
    originals: DataFrame | None = None,
) -> DataFrame:
    """All drift measures, one row per setting and feature.

    ``original`` is the wide frame without settings, ``frame`` the one with masked columns, every row of
    ``original`` once for each setting. ``originals`` are its ``original_points`` if they are known.
    """
    old_cube, new_cube = cubes or (original_cube(original, spec), masked_cube(frame, spec))
    before, after = settle(moments(old_cube, spec).drop("config_id")), settle(moments(new_cube, spec))
    edges = edges or spec_edges(original, spec)
    bounds = pooled_bounds(before, after)
    originals = original_points(original, spec, edges) if originals is None else originals
    # bounds: one row per setting and feature.
    numbers = number_points(frame, spec, edges, originals.join(F.broadcast(bounds.select(*CELL)), "feature"))
    codes = code_points(new_cube, spec)
    hist = settle(histogram(numbers, bounds).unionByName(histogram(codes, bounds)))
    return _all_measures(before, after, distances(numbers, hist), kl_divergence(hist, bounds))


def _all_measures(before: DataFrame, after: DataFrame, found: DataFrame, divergence: DataFrame) -> DataFrame:
    return (
        moment_drift(before, after)
        .join(found, CELL)
        .join(divergence, CELL, "left")
        .select(
            *CELL, "t_statistic", "approximate_p_value", "ks_statistic",
            F.coalesce(F.col("kl_divergence"), F.lit(0.0)).alias("kl_divergence"),
            "wasserstein_distance", "original_variance", "masked_variance", "variance_preservation", "mean_shift",
        )
    )


def counted_drift(
    spec: MaskSpec,
    cubes: tuple[DataFrame, DataFrame],
    originals: DataFrame,
    counts: DataFrame,
    values: Callable[[dict[tuple[int, str], list[int]]], DataFrame],
) -> DataFrame:
    """``drift_table`` from masked rows that were counted by bucket before anything was known of them.

    ``counts`` has masked rows, their sum and bounds per setting, feature and bucket. A bucket whose values
    are all in one divergence bin needs no more for the divergence. ``values`` gives the masked values
    of the buckets that it is asked for: those that are unsettled or in several bins.
    """
    old_cube, new_cube = cubes
    before, after = settle(moments(old_cube, spec).drop("config_id")), settle(moments(new_cube, spec))
    bounds = pooled_bounds(before, after)
    places, none, empty = [*CELL, "bucket"], F.lit(0).cast("bigint"), F.lit(0.0)
    lone = originals.groupBy("feature", "bucket").agg(
        F.sum("a").alias("n_a"), F.sum(F.col("a") * F.col("value")).alias("s_a"),
        F.min("value").alias("first_value"), F.max("value").alias("last_value"),
    )
    sides = counts.select("*", none.alias("n_a"), empty.alias("s_a")).unionByName(
        # bounds: one row per setting and feature.
        lone.join(F.broadcast(bounds.select(*CELL)), "feature").select("*", none.alias("n_b"), empty.alias("s_b"))
    )
    buckets = sides.groupBy(*places).agg(
        *[F.sum(c).alias(c) for c in ("n_a", "n_b", "s_a", "s_b")],
        F.min("first_value").alias("first_value"), F.max("last_value").alias("last_value"),
    )
    low, high = F.col("pooled_low"), F.col("pooled_high")
    buckets = buckets.join(F.broadcast(bounds), CELL).withColumn("kl_bin", kl_bin(F.col("first_value"), low, high))
    buckets = buckets.withColumn("split", F.col("kl_bin") != kl_bin(F.col("last_value"), low, high))
    codes = histogram(code_points(new_cube, spec), bounds).withColumn("split", F.lit(False))
    hist = settle(buckets.select(codes.columns).unionByName(codes))
    ends = settle(bucket_ends(hist))
    open_ones = settle(ends.where("unsettled").select(*places).unionByName(hist.where("split").select(*places)).distinct())
    wanted: dict[tuple[int, str], list[int]] = {}
    # One small row per setting, feature and open bucket: bounded by the grid of buckets.
    for config_id, feature, bucket in open_ones.collect():
        wanted.setdefault((config_id, feature), []).append(bucket)
    old = originals.join(F.broadcast(open_ones), ["feature", "bucket"])
    points = old.select(*places, "value", "a", none.alias("b"))
    if wanted:
        points = points.unionByName(settle(values(wanted)).withColumn("a", none))
    split = points.join(F.broadcast(hist.where("split").select(*places)), places, "left_semi")
    binned = hist.where("not split").drop("split").unionByName(histogram(split, bounds))
    return _all_measures(before, after, distances(points, hist, ends=ends), kl_divergence(binned, bounds))


def mean_drift(drift: DataFrame) -> DataFrame:
    """Means over the features, one row per setting."""
    return drift.groupBy("config_id").agg(
        F.avg("ks_statistic").alias("mean_ks_statistic"),
        F.avg("kl_divergence").alias("mean_kl_divergence"),
        F.avg("wasserstein_distance").alias("mean_wasserstein_distance"),
        F.avg("variance_preservation").alias("mean_variance_preservation"),
    )
