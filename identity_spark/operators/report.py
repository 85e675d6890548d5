"""Counts of frames and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_summary(observations: DataFrame) -> DataFrame:
    """Detections, embedded crops and identified tracks of each frame; observations: embedded (boolean), global_id."""
    return observations.groupBy("camera_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_detections"), F.count_if("embedded").alias("n_embedded"), F.count("global_id").alias("n_identified"))


def stage_metrics(summary: DataFrame, every: int = 30, timings: list[str] | None = None) -> DataFrame:
    """Sums and means of :func:`frame_summary` over every so many frames; timings: columns of a frame's milliseconds by
    stage, of which mean_<column> and max_<column> are given."""
    taken = [f(c).alias(f"{n}_{c}") for c in timings or [] for n, f in (("mean", F.avg), ("max", F.max))]
    return summary.groupBy("camera_id", F.expr(f"frame_idx div {every}").alias("window")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("n_detections").alias("n_detections"), F.sum("n_embedded").alias("n_embedded"), F.avg("n_detections").alias("mean_detections"), *taken
    )
