"""Readers and writers (CSV and Parquet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.joins import join_summary
from veilframe.operators.ranking import running_totals
from veilframe.session import settle

# File names tried in a data folder, first match wins.
DEFAULT_FILES = ("adult.csv", "adult_income.csv", "synthetic_adult_income.csv")

# Cell texts that the pandas CSV reader treats as missing by default.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Blanks at the ends of a cell are kept: a cell of " ?" is not the missing mark "?".
CSV_WRITING = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns ``path`` (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exist: {', '.join(paths)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text (no inference pass); usual missing marks become null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*CSV_MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    lowered = path.rstrip("/").lower()
    if lowered.endswith((".csv", ".csv.gz", ".csv.bz2")):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_numbered(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """A Parquet table with consecutive row numbers from 0, in the order of its files and of the rows in them.

    Each row knows its file and its place in it, so only the rows before each file are counted, in a
    pass that reads no column. Nothing is written, and a task that runs again finds the same numbers.
    """
    rows = spark.read.parquet(path)
    placed = rows.withColumns({"__file": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
    files = settle(placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows")))
    before = running_totals(files, [], "__file", ["__rows"])
    starts = before.select("__file", (F.col("__rows_upto") - F.col("__rows")).alias("__start"))
    numbered = join_summary(placed, starts.select(F.col("__file").alias("file"), "__start"), {"file": F.col("__file")})
    return numbered.withColumn(name, F.col("__start") + F.col("__place")).drop("__file", "__place", "__start")


def read_people(spark: SparkSession, data_dir: str, files: Sequence[str] = DEFAULT_FILES) -> DataFrame:
    """First existing file of a data folder; raises when there is none."""
    return read_table(spark, first_existing(spark, [f"{data_dir.rstrip('/')}/{name}" for name in files]))


def write_rows(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Row-level output keeps Spark's partitioning: one file per task, never one task."""
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.options(**CSV_WRITING).csv(path)
    else:
        writer.format(file_format).save(path)


def write_report(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Report output: a table whose size depends on settings and features, not on rows."""
    write_rows(df.coalesce(1), path, file_format)
