"""Numeric projection of a released table whose cells may be numbers, ranges or levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import level_to_number, range_midpoint, to_number
from veilframe.operators.joins import join_summary
from veilframe.operators.ranking import BUCKET_ROWS, exact_median, running_totals
from veilframe.spec import MaskSpec

NULL_TEXT = "nan"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def as_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NULL_TEXT))


def is_numeric(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith(NUMERIC_TYPES)


def number_of(df: DataFrame, column: str) -> Column:
    """A column's numbers; only texts are parsed. Unreadable text and NaN become null."""
    if is_numeric(df, column):
        value = F.col(column).cast("double")
        return F.when(~F.isnan(value), value)
    return to_number(F.col(column))


def number_or_midpoint(df: DataFrame, column: str) -> Column:
    """A range text gives its midpoint, anything else its number, else null."""
    number = number_of(df, column)
    return number if is_numeric(df, column) else F.coalesce(range_midpoint(F.col(column)), number)


def text_codes(values: DataFrame, keys: Sequence[str], column: str, code: str, part_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct ``keys`` and texts with the text's sorted position, from 0, among those of the same keys.

    Positions are counted over ranges of about ``part_rows`` texts, whatever the texts have in common.
    """
    counted = running_totals(values.withColumn("__one", F.lit(1).cast("bigint")), keys, column, ["__one"], part_rows)
    return counted.select(*keys, column, (F.col("__one_upto") - 1).alias(code))


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct texts of a column with their sorted position from 0."""
    return text_codes(df.select(as_text(F.col(column)).alias("value")).distinct(), [], "value", "code")


def add_category_code(df: DataFrame, column: str, name: str) -> DataFrame:
    """Code of each text in the table's own dictionary, joined as its size allows."""
    codes = category_dictionary(df, column).select("value", F.col("code").cast("double").alias(name))
    return join_summary(df, codes, {"value": as_text(F.col(column))})


def project_numbers(df: DataFrame, spec: MaskSpec, keep: Sequence[str] = ()) -> DataFrame:
    """All columns as numbers, one per feature.

    When any flag cell is not a number, the whole flag column is read as low/high levels
    and its remaining numbers become 0.
    """
    flag = number_of(df, spec.flag)
    unreadable = df.agg(F.bool_or(flag.isNull()).alias("any_text")).scalar()
    flag = F.when(F.coalesce(unreadable, F.lit(False)), level_to_number(F.col(spec.flag))).otherwise(flag)
    coded = df
    for column in spec.texts:
        coded = add_category_code(coded, column, f"{column}_code")
    return coded.select(
        *keep,
        F.coalesce(number_or_midpoint(df, spec.numeric), F.lit(0.0)).alias(spec.numeric),
        F.coalesce(flag, F.lit(0.0)).alias(spec.flag),
        *[F.coalesce(F.col(f"{c}_code"), F.lit(0.0)).alias(f"{c}_code") for c in spec.texts],
    )


def fill_numbers(df: DataFrame, spec: MaskSpec) -> DataFrame:
    """Numbers for masking: number, else range or level, else median, else the default."""
    medians = median_values(df, spec)
    number, flag = _readable(df, spec)
    return df.withColumns(
        {
            spec.numeric: F.coalesce(number, F.lit(medians[spec.numeric]), F.lit(spec.numeric_default)),
            spec.flag: F.coalesce(flag, F.lit(medians[spec.flag]), F.lit(0.0)),
        }
    )


def _readable(df: DataFrame, spec: MaskSpec) -> tuple[Column, Column]:
    number, flag = number_of(df, spec.numeric), number_of(df, spec.flag)
    if not is_numeric(df, spec.numeric):
        number = F.coalesce(number, range_midpoint(F.col(spec.numeric)))
    if not is_numeric(df, spec.flag):
        flag = F.coalesce(flag, level_to_number(F.col(spec.flag)))
    return number, flag


def median_values(df: DataFrame, spec: MaskSpec) -> dict[str, float | None]:
    """Medians of the readable numbers after ranges and levels are read; skipped when no cell is missing."""
    number, flag = _readable(df, spec)
    missing = df.agg(F.count_if(number.isNull() | flag.isNull())).first()[0]
    if not missing:
        return {spec.numeric: None, spec.flag: None}
    return {spec.numeric: exact_median(df, number), spec.flag: exact_median(df, flag)}
