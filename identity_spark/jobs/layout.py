"""Tracks in one layout that all work by track shares: bucketed and sorted by (camera, track), frames numbered.

Rows are shuffled once, when they are written. Windows by track (W1 to W6) and joins to tables of tracks in the same layout
(J3, J13, a track's identity) then read their buckets as they are, with no exchange; frame numbers, which windows by
camera would need the frames of all tracks for, are in the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tracklets import TRACK

FRAME = ["camera_id", "frame_idx"]


def numbered(tracks: DataFrame) -> DataFrame:
    """Adds frame_seq: a frame's number among its camera's frames that have rows."""
    frames = tracks.select(*FRAME).distinct()
    return tracks.join(frames.withColumn("frame_seq", F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_idx"))), FRAME)


def write_by_track(rows: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Writes rows with camera_id and tracker_id as the table ``table`` in ``path``, a file a bucket, and reads it.

    buckets: for all tables that are to meet the same number, so that a bucket's tracks fit a task. Rows with a frame_idx are
    sorted by it inside a track."""
    order = [*TRACK, *(["frame_idx"] if "frame_idx" in rows.columns else [])]
    dealt = rows.repartition(buckets, *TRACK)
    dealt.write.bucketBy(buckets, *TRACK).sortBy(*order).option("path", path).mode("overwrite").format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles of a table's plan, as Spark names them: none where work stays in its buckets."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange SinglePartition" in line]


def drop(spark: SparkSession, table: str) -> None:
    """Forgets a table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
