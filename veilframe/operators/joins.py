"""Joins of a table with a summary of itself.

The summary (a dictionary, the sizes of classes) has one row for each key, while the table may
have most of its rows under a few keys. Shuffling the table by that key would send them to a few
tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import settle

BROADCAST_ROWS = 100_000  # a summary of more rows is not sent to every task
SALTS = 16


def join_summary(df: DataFrame, summary: DataFrame, on: Mapping[str, Column], limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``df`` with the other columns of ``summary``; ``on`` gives the expression over ``df`` for each key of it.

    Missing keys match missing keys; rows without a partner get nulls. The summary is counted: up to
    ``limit`` rows are broadcast, so the table is not moved. A longer one meets the table by key and
    salt, where each of its rows stands once for every salt: then the rows of one key are dealt to
    ``salts`` tasks. Such a summary is never broadcast, whatever Spark's guess of its size: that comes
    from compressed files and leaves the salts out.
    """
    kept = settle(summary.select(*[F.col(k).alias(f"__key_{k}") for k in on], *[c for c in summary.columns if c not in on]))
    same = [column.eqNullSafe(F.col(f"__key_{k}")) for k, column in on.items()]
    keys = [f"__key_{k}" for k in on]
    if kept.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(kept), same, "left").drop(*keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    spread = kept.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread.hint("merge"), [*same, F.col("__salt") == F.col("__turn")], "left").drop(*keys, "__salt", "__turn")
