"""Session helpers: shared folder, checkpoints, sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        found = context.getCheckpointDir()
    if found is None:
        found = "file://" + tempfile.mkdtemp(prefix="boxwright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame, light: bool = False) -> DataFrame:
    """Written to the shared folder and read from there: cuts lineage and outlives lost executors.

    ``light`` says that a row is a few numbers, out of a shuffle: eight partitions then go to a file, though never fewer
    files than four a core. On a local folder Hadoop starts two processes for each file, and one that is being
    started counts as a second JVM.
    """
    shared_dir(df.sparkSession)
    if light:
        df = df.coalesce(max(-(-shuffle_partitions(df.sparkSession) // 8), 4 * df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
