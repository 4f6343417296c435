"""Small numeric and text expressions that keep working under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Cell texts that mean "missing".
MISSING_TOKENS = ("?", "nan", "None")

# Chebyshev coefficients of the complementary error function
# (Numerical Recipes, "erfcc"), highest order last.
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def as_column(value: Column | str | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def to_number(column: Column) -> Column:
    """Text or number to DOUBLE; unreadable text and NaN become null."""
    text = column.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def strip(column: Column) -> Column:
    """Remove leading and trailing white space, tabs and line breaks included."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def missing_to_null(column: Column) -> Column:
    return F.when(~column.isin(*MISSING_TOKENS), column)


def clip(column: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp a non-null value; a null stays null (least/greatest would skip it)."""
    bounded = F.greatest(F.least(column, as_column(high)), as_column(low))
    return F.when(column.isNotNull(), bounded)


def clip01(column: Column) -> Column:
    return clip(column, 0.0, 1.0)


def range_midpoint(column: Column) -> Column:
    """Mean of the two sides of the first ``-`` in a text such as ``20-39``, else null."""
    text = column.cast("string")
    left = F.regexp_extract(text, r"^([^-]*)-([\s\S]*)$", 1)
    right = F.regexp_extract(text, r"^([^-]*)-([\s\S]*)$", 2)
    return (to_number(left) + to_number(right)) / F.lit(2.0)


def level_to_number(column: Column) -> Column:
    """``low`` to 0 and ``high`` to 1, whatever the letter case; anything else is null."""
    text = F.lower(column.cast("string"))
    return F.when(text == "low", F.lit(0.0)).when(text == "high", F.lit(1.0))


def safe_ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(otherwise))


def normal_p_value(t: Column) -> Column:
    """Two-sided p value of a standard normal statistic."""
    x = F.abs(t) / F.sqrt(F.lit(2.0))
    s = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    polynomial = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        polynomial = F.lit(coefficient) + s * polynomial
    return F.least(s * F.exp(-x * x + polynomial), F.lit(1.0))


def rounded(column: Column, places: int = 6) -> Column:
    """Round for reporting; a negative zero becomes zero."""
    value = F.round(column.cast("double"), places)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)
