"""From raw headers and cells to the clean person table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.functions.numeric import clip, missing_to_null, strip, to_number
from veilframe.operators.ranking import cut_points, up_to
from veilframe.spec import MaskSpec

# Accepted headers per column in order of preference, and the income pattern.
HEADERS = {
    "age": ("age",),
    "gender": ("gender", "sex"),
    "income": ("income", "class", "target"),
    "education": ("education",),
    "occupation": ("occupation",),
}
EXACT_HEADERS = {name.title(): name for name in HEADERS}
HIGH_INCOME = r"(?i)>50K|1|high"
AGE_LOW, AGE_HIGH, INCOME_CUT = 18, 90, 0.5


def normal_header(name: str) -> str:
    return name.strip().lower().replace("-", "_")


def resolve_headers(columns: Sequence[str]) -> dict[str, str]:
    """Target column to source header. An exact ``Income`` beats ``class``; a missing column raises."""
    by_key = {normal_header(c): c for c in columns}
    found = {}
    for target, accepted in HEADERS.items():
        hit = next((by_key[key] for key in accepted if key in by_key), None)
        if hit is None:
            raise KeyError(f"no column for {target}: expected one of {', '.join(accepted)}")
        found[target] = hit
    return found


def _source(name: str) -> Column:
    return F.col(f"`{name}`")


def income_flag(text: Column) -> Column:
    """1 when the text names the high class anywhere, else 0; never null."""
    return F.coalesce(text.cast("string").rlike(HIGH_INCOME), F.lit(False)).cast("int")


def person_cells(df: DataFrame, row_id: str = "row_id", strict: bool = False) -> DataFrame:
    """Five typed columns from raw cells, nulls not yet dropped.

    With the exact headers, missing marks are matched on whole untrimmed cells. With other
    headers, cells are trimmed first and income is read as text. Exact headers with income
    as text use the text reading too, unless ``strict`` asks to lose those rows.
    """
    if set(EXACT_HEADERS) <= set(df.columns):
        cell = {target: missing_to_null(_source(header).cast("string")) for header, target in EXACT_HEADERS.items()}
        income = to_number(cell["income"])
        if not strict:
            income = F.when(cell["income"].isNotNull(), F.coalesce(income, income_flag(cell["income"])))
    else:
        source = {target: _source(header) for target, header in resolve_headers(df.columns).items()}
        cell = {target: missing_to_null(strip(c.cast("string"))) for target, c in source.items()}
        income = income_flag(source["income"])
    return df.select(
        row_id,
        to_number(cell["age"]).alias("age"),
        cell["gender"].alias("gender"),
        income.cast("double").alias("income"),
        cell["education"].alias("education"),
        cell["occupation"].alias("occupation"),
    )


def clean_people(df: DataFrame, row_id: str = "row_id", strict: bool = False) -> DataFrame:
    """Clean person table: complete rows, age a whole number 18..90, income 0/1, trimmed texts."""
    cells = person_cells(df, row_id, strict).dropna(subset=list(HEADERS))
    return cells.select(
        row_id,
        F.bround(clip(F.col("age"), float(AGE_LOW), float(AGE_HIGH))).cast("int").alias("age"),
        strip(F.col("gender")).alias("gender"),
        binary_target(F.col("income")).alias("income"),
        strip(F.col("education")).alias("education"),
        strip(F.col("occupation")).alias("occupation"),
    )


def binary_target(column: Column) -> Column:
    """1 from one half upwards, else 0; a missing or unreadable value counts as 0."""
    return (F.coalesce(to_number(column), F.lit(0.0)) >= F.lit(INCOME_CUT)).cast("int")


def repeated_ids(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row ids that occur more than once; rows that share an id would share their noise."""
    return df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def cap_rows(df: DataFrame, limit: int, spec: MaskSpec, draws: Draws, rows: int | None = None) -> DataFrame:
    """Exactly ``limit`` rows without replacement (all rows when there are fewer).

    The limit-th smallest draw is found first; keeping the rows up to it is a filter, so a
    large limit costs no more than a small one and nothing is gathered in one task.
    """
    rows = df.count() if rows is None else rows
    if limit >= rows:
        return df
    if limit <= 0:
        return df.limit(0)
    drawn = df.withColumns({"__u": draws.uniform("cap", "cap", F.col(spec.row_id)), "__all": F.lit(0)})
    cut = cut_points(drawn, "__all", "__u", spec.row_id, {0: [limit]}, rows)[(0, limit)]
    kept = up_to(F.col("__u"), F.col(spec.row_id), F.lit(cut[0]), F.lit(cut[1]))
    return drawn.where(kept).drop("__u", "__all")


def share_rows(df: DataFrame, share: float, spec: MaskSpec, draws: Draws) -> DataFrame:
    """About ``share`` of the rows by a filter alone, for tables too large to rank."""
    return df.where(draws.uniform("cap", "cap", F.col(spec.row_id)) < F.lit(float(share)))
