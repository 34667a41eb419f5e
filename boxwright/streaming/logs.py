"""Training logs as streams: the epoch records of files that are still being added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.reports import epochs


def epoch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """file, epoch, total_epochs and the three losses of the lines of log files as they come."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return epochs(lines).drop("line")


def latest_epochs(stream: DataFrame) -> DataFrame:
    """The last epoch of each file so far: state of one row a file. Write it in update or complete mode."""
    return stream.groupBy("file").agg(F.max(F.struct("epoch", "total_epochs", "box_loss", "cls_loss", "dfl_loss")).alias("r")).select("file", "r.*")
