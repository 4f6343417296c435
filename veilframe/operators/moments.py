"""Moments, covariance and correlation from one map-side-combined pass.

The rows are grouped by their category values only (the "cube"). Each group keeps its size and the
mean, variance and covariance of the two numbers, which is all that the table-wide
moments of every feature need: category codes are constant inside a group. So codes need
no dictionary pass and no join against the rows, and what is shuffled grows with the
number of category combinations, not with the rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.project import as_text, text_codes
from veilframe.session import settle
from veilframe.spec import MaskSpec

ALL_ROWS = "config_id"
CUBE_ROWS = 100_000  # a cube of more groups is coded by distributed ranks


def _number(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def _group_values(number: Column, flag: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(number).alias("number_mean"),
        F.avg(flag).alias("flag_mean"),
        F.var_pop(number).alias("number_var"),
        F.var_pop(flag).alias("flag_var"),
        F.covar_pop(number, flag).alias("cross"),
        F.min(number).alias("number_min"),
        F.max(number).alias("number_max"),
        F.min(flag).alias("flag_min"),
        F.max(flag).alias("flag_max"),
    ]


def original_cube(frame: DataFrame, spec: MaskSpec) -> DataFrame:
    """Category groups of the original side; ``frame`` is a wide frame without settings."""
    keys = [as_text(F.col(f"o_{spec.category}")).alias(spec.category), *[as_text(F.col(c)).alias(c) for c in spec.carried]]
    number, flag = _number(f"o_{spec.numeric}"), _number(f"o_{spec.flag}")
    return _settled(frame.groupBy(F.lit(-1).alias(ALL_ROWS), *keys).agg(*_group_values(number, flag)), spec)


def masked_cube(frame: DataFrame, spec: MaskSpec) -> DataFrame:
    """Category groups of the masked side per setting, with the distance to the original."""
    number, flag = _number(f"m_{spec.numeric}"), _number(f"m_{spec.flag}")
    old_number, old_flag = _number(f"o_{spec.numeric}"), _number(f"o_{spec.flag}")
    cube = frame.groupBy(
        ALL_ROWS,
        as_text(F.col(f"o_{spec.category}")).alias("old_category"),
        as_text(F.col(f"m_{spec.category}")).alias(spec.category),
        *[as_text(F.col(c)).alias(c) for c in spec.carried],
    ).agg(
        *_group_values(number, flag),
        F.avg(F.abs(old_number - number)).alias("number_gap"),
        F.avg(F.abs(old_flag - flag)).alias("flag_gap"),
        F.min(old_number).alias("old_number_min"),
        F.max(old_number).alias("old_number_max"),
        F.min(old_flag).alias("old_flag_min"),
        F.max(old_flag).alias("old_flag_max"),
    )
    return _settled(cube, spec)


def table_cube(df: DataFrame, spec: MaskSpec) -> DataFrame:
    """Category groups of any clean table with the role columns."""
    renamed = df.select(
        F.col(spec.numeric).alias(f"o_{spec.numeric}"),
        F.col(spec.flag).alias(f"o_{spec.flag}"),
        F.col(spec.category).alias(f"o_{spec.category}"),
        *spec.carried,
    )
    return original_cube(renamed, spec)


def _settled(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """The cube, kept once, with the code of every text."""
    return coded_cube(settle(cube), spec)


def coded_cube(kept: DataFrame, spec: MaskSpec) -> DataFrame:
    """A kept cube with the code of every text.

    A code is the position among the sorted distinct texts of the same table and setting.
    """
    columns = {f"{c}_code": c for c in spec.texts}
    if "old_category" in kept.columns:
        columns["old_code"] = "old_category"
    if kept.limit(CUBE_ROWS + 1).count() <= CUBE_ROWS:
        # Few groups are ordered where they are; the codes of all columns share one exchange.
        place = {c: F.dense_rank().over(Window.partitionBy(ALL_ROWS).orderBy(c)) - 1 for c in columns.values()}
        return kept.withColumns({code: place[c].cast("double") for code, c in columns.items()})
    coded = kept
    for code, column in columns.items():
        codes = text_codes(kept.select(ALL_ROWS, column).distinct(), [ALL_ROWS], column, code)
        coded = coded.join(codes.withColumn(code, F.col(code).cast("double")), [ALL_ROWS, column])
    return coded


def _group_mean(spec: MaskSpec, feature: str) -> str:
    """Column of the cube that holds a feature's mean inside a category group."""
    return {spec.numeric: "number_mean", spec.flag: "flag_mean"}.get(feature, f"`{feature}`")


def _group_bound(spec: MaskSpec, feature: str, which: str) -> str:
    return {spec.numeric: f"number_{which}", spec.flag: f"flag_{which}"}.get(feature, f"`{feature}`")


def _within(spec: MaskSpec, a: str, b: str) -> str:
    """Covariance inside a category group; zero whenever a code takes part."""
    inside = {
        (spec.numeric, spec.numeric): "number_var",
        (spec.flag, spec.flag): "flag_var",
        (spec.numeric, spec.flag): "cross",
    }
    return inside.get((a, b), "0D")


def moments_wide(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """One row per setting: size, and per feature ``mean_i``, ``min_i``, ``max_i``; per pair ``co_i_j``.

    ``i`` and ``j`` are positions in ``spec.features``. A co-moment is the sum over groups of
    n x (covariance inside + product of the group's distances to the means), and exactly zero
    when a feature is constant.
    """
    features = list(enumerate(spec.features))
    means = cube.groupBy(ALL_ROWS).agg(
        *[F.expr(f"sum(n * {_group_mean(spec, f)}) / sum(n)").alias(f"mean_{i}") for i, f in features]
    )
    centred = cube.join(F.broadcast(means), ALL_ROWS)  # one row per setting
    pairs = [(i, j, a, b) for (i, a), (j, b) in combinations_with_replacement(features, 2)]
    sums = centred.groupBy(ALL_ROWS).agg(
        F.expr("sum(n)").alias("n"),
        *[F.expr(f"first(mean_{i})").alias(f"mean_{i}") for i, _ in features],
        *[F.expr(f"min({_group_bound(spec, f, 'min')})").alias(f"min_{i}") for i, f in features],
        *[F.expr(f"max({_group_bound(spec, f, 'max')})").alias(f"max_{i}") for i, f in features],
        *[
            F.expr(
                f"sum(n * ({_within(spec, a, b)} + ({_group_mean(spec, a)} - mean_{i}) * ({_group_mean(spec, b)} - mean_{j})))"
            ).alias(f"raw_{i}_{j}")
            for i, j, a, b in pairs
        ],
    )
    kept = [ALL_ROWS, "n", *[f"{name}_{i}" for name in ("mean", "min", "max") for i, _ in features]]
    return sums.selectExpr(
        *kept, *[f"IF(min_{i} < max_{i} AND min_{j} < max_{j}, raw_{i}_{j}, 0D) AS co_{i}_{j}" for i, j, _, _ in pairs]
    )


def moments(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """Per setting and feature: rows, mean, sample variance, population deviation, bounds."""
    return moments_long(moments_wide(cube, spec), spec)


def moments_long(wide: DataFrame, spec: MaskSpec) -> DataFrame:
    rows = [
        f"named_struct('feature', '{f}', 'n', n, 'mean', mean_{i}, "
        f"'variance', coalesce(try_divide(co_{i}_{i}, n - 1), 0D), 'std_pop', sqrt(co_{i}_{i} / n), "
        f"'low', double(min_{i}), 'high', double(max_{i}))"
        for i, f in enumerate(spec.features)
    ]
    return wide.selectExpr(ALL_ROWS, f"inline(array({', '.join(rows)}))")


def matrices(cube: DataFrame, spec: MaskSpec) -> DataFrame:
    """Covariance and correlation in long form, all ordered pairs; undefined cells are 0."""
    return matrices_long(moments_wide(cube, spec), spec)


def matrices_long(wide: DataFrame, spec: MaskSpec) -> DataFrame:
    features = list(enumerate(spec.features))
    spread = wide.selectExpr("*", *[f"sqrt(co_{i}_{i}) AS root_{i}" for i, _ in features])

    def cell(i: int, a: str, j: int, b: str) -> str:
        product = f"co_{min(i, j)}_{max(i, j)}"
        return (
            f"named_struct('feature_a', '{a}', 'feature_b', '{b}', "
            f"'covariance', coalesce(try_divide({product}, n - 1), 0D), "
            f"'correlation', coalesce(try_divide({product}, root_{i} * root_{j}), 0D))"
        )

    cells = [cell(i, a, j, b) for i, a in features for j, b in features]
    return spread.selectExpr(ALL_ROWS, f"inline(array({', '.join(cells)}))")


def profile(df: DataFrame, spec: MaskSpec) -> tuple[DataFrame, DataFrame]:
    """Moments and matrices of one clean table."""
    cube = table_cube(df, spec)
    return moments(cube, spec).drop(ALL_ROWS), matrices(cube, spec).drop(ALL_ROWS)
