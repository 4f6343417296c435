"""Mutual information of a number with a class label by nearest neighbours (Ross 2014).

For each row, the distance to its k-th nearest neighbour of the same class says how dense the
class is there, and the number of rows of any class that are nearer says how dense the table
is. On one number, neighbours stand next to each other in the order of values, so no index is
needed: values are numbered by ranges, blocks of consecutive values take in the first and last k
values of their neighbour blocks, and ranges of values are counted from running totals. Equal
rows are one weighted value throughout, so a value with a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.ranking import BUCKET_ROWS, running_totals
from veilframe.session import settle

NEIGHBOURS = 3


def digamma(x: Column) -> Column:
    """Logarithmic derivative of the gamma function for x >= 1: eight steps up, then its asymptotic series."""
    steps = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(1, 8)), F.lit(1.0) / x)
    y = x + F.lit(8.0)
    square = F.lit(1.0) / (y * y)
    series = square * (F.lit(1 / 12) - square * (F.lit(1 / 120) - square * (F.lit(1 / 252) - square * F.lit(1 / 240))))
    return F.log(y) - F.lit(0.5) / y - series - steps


def neighbour_distance(cells: DataFrame, k: int = NEIGHBOURS, block_rows: int = BUCKET_ROWS) -> DataFrame:
    """``cells`` (feature, y, value, n) with ``near``, the neighbours that count in the class, and ``distance`` to the last of them.

    A class of fewer than k + 1 rows counts all its others; a class of one row is left out.
    """
    counted = running_totals(cells.withColumn("one", F.lit(1).cast("bigint")), ["feature", "y"], "value", ["one"], block_rows)
    block_rows = max(block_rows, k)
    place = F.col("one_upto") - 1
    home, at = F.floor(place / block_rows), place % block_rows
    blocks = F.array_compact(
        F.array(home, F.when((at < k) & (home > 0), home - 1), F.when(at >= block_rows - k, home + 1))
    )
    dealt = counted.select("feature", "y", "value", "n", home.alias("home"), F.explode(blocks).alias("block"))
    around = Window.partitionBy("feature", "y", "block").orderBy("value").rowsBetween(-k, k)
    seen = dealt.withColumn("seen", F.collect_list(F.struct("value", "n")).over(around)).where("home = block")
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("class_rows")).where("class_rows > 1")
    seen = seen.join(sizes, ["feature", "y"]).withColumn("near", F.least(F.col("class_rows") - 1, F.lit(k)))
    # Nearest first; the row itself is not its own neighbour, its equals are at distance 0.
    steps = F.array_sort(
        F.transform("seen", lambda s: F.struct(F.abs(s["value"] - F.col("value")).alias("d"), F.when(s["value"] == F.col("value"), s["n"] - 1).otherwise(s["n"]).alias("n")))
    )
    reached = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("d")),
        lambda a, s: F.struct((a["n"] + s["n"]).alias("n"), F.when(a["n"] < F.col("near"), s["d"]).otherwise(a["d"]).alias("d")),
    )
    return seen.select("feature", "y", "value", "n", "class_rows", "near", reached["d"].alias("distance"))


def nearest_information(
    df: DataFrame, numbers: Mapping[str, Column], label: str = "label", k: int = NEIGHBOURS, part_rows: int = BUCKET_ROWS
) -> DataFrame:
    """feature, mutual_information (nats, at least 0) of each number with the label.

    With r the distance to a row's k-th neighbour of its class and m the rows of any class strictly
    between value - r and value + r (its equals where r is 0), the estimate is
    digamma(rows) + mean(digamma(k)) - mean(digamma(class rows)) - mean(digamma(m)). Rows without
    the number or the label, and classes of one row, are left out; a number without rows has no row.
    """
    items = [F.struct(F.lit(name).alias("feature"), column.cast("double").alias("value")) for name, column in numbers.items()]
    rows = df.select(F.col(label).alias("y"), F.explode(F.array(*items)).alias("item")).select("y", "item.*")
    cells = rows.where("y is not null and value is not null and not isnan(value)").groupBy("feature", "y", "value")
    cells = settle(cells.agg(F.count(F.lit(1)).alias("n")))
    spaced = settle(neighbour_distance(cells, k, part_rows).withColumns({"low": F.col("value") - F.col("distance"), "high": F.col("value") + F.col("distance")}))
    none = F.lit(0).cast("bigint")
    marks = [spaced.select("feature", F.col("value").alias("x"), "n"), *[spaced.select("feature", F.col(c).alias("x"), none.alias("n")) for c in ("low", "high")]]
    line = marks[0].union(marks[1]).union(marks[2]).groupBy("feature", "x").agg(F.sum("n").alias("n"))
    line = settle(running_totals(line, ["feature"], "x", ["n"], part_rows).select("feature", "x", "n", "n_upto"))
    upto_low = line.select("feature", F.col("x").alias("low"), F.col("n_upto").alias("to_low"), F.col("n").alias("at_low"))
    upto_high = line.select("feature", F.col("x").alias("high"), (F.col("n_upto") - F.col("n")).alias("under_high"))
    found = spaced.join(upto_low, ["feature", "low"]).join(upto_high, ["feature", "high"])
    between = F.when(F.col("distance") > 0, F.col("under_high") - F.col("to_low")).otherwise(F.col("at_low")).cast("double")
    weight = F.col("n").cast("double")
    term = digamma(F.col("near").cast("double")) - digamma(F.col("class_rows").cast("double")) - digamma(between)
    estimate = digamma(F.sum(weight)) + F.sum(weight * term) / F.sum(weight)
    return found.groupBy("feature").agg(F.greatest(estimate, F.lit(0.0)).alias("mutual_information"))
