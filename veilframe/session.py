"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "veilframe") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VEILFRAME_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # The JVM never compiles methods above 8000 bytes; past that, Spark's split code is faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a folder in the warehouse where it is unset.

    Driver and executors share both, so a lost executor costs no checkpoint.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def shared_table_path(spark: SparkSession, name: str) -> str:
    """Folder for a table this application writes to cut lineage, beside its checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-{name}"


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a summary that several later steps read.

    The pass over the rows then runs once, and a lost executor cannot make it run again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
