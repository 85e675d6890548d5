"""The folder for checkpoints, and broadcasts behind a count."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables of more rows are joined by a shuffle and not broadcast.
BROADCAST_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set and Spark is one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="identity-spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of :func:`checkpoint_folder`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a hint to broadcast it where its rows, which are counted, allow that."""
    return F.broadcast(df) if df.count() <= most else df
