"""Poses: quality, association with boxes, reuse over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..params import DEFAULTS, FULL_BODY, NONE, UPPER_BODY, Params
from .crowd import CROWD, pairs_in_frames

#: Places of key points in a pose of 17 points.
HEAD, SHOULDERS, HIPS = (0, 1, 2), (5, 6), (11, 12)


def quality(kps: Column, least: float) -> Column:
    """FULL: both shoulders and both hips are visible; UPPER: both shoulders and a part of the head; else NONE."""
    seen = lambda i: F.element_at(kps, i + 1)["c"] >= least
    shoulders = seen(SHOULDERS[0]) & seen(SHOULDERS[1])
    hips = seen(HIPS[0]) & seen(HIPS[1])
    head = seen(HEAD[0]) | seen(HEAD[1]) | seen(HEAD[2])
    return F.when(shoulders & hips, FULL_BODY).when(shoulders & head, UPPER_BODY).otherwise(NONE)


def filter_poses(poses: DataFrame, scale: float = 1.0, params: Params = DEFAULTS) -> DataFrame:
    """Poses above the score, in pixels of the frame; confidences of points stay."""
    kept = poses.filter(F.col("score") >= params.pose_conf_threshold)
    points = F.transform("kps", lambda k: F.struct((k["x"] / scale).alias("x"), (k["y"] / scale).alias("y"), k["c"].alias("c")))
    return kept.withColumns({**{e: F.col(e) / scale for e in boxes.EDGES}, "kps": points, "quality": quality(points, params.pose_conf_threshold)})


def qualifies(quality_column: Column, params: Params = DEFAULTS, pose_off: bool = False) -> Column:
    """Whether an observation may be embedded; without poses, or without a least quality, all may."""
    if pose_off or params.least_quality == NONE:
        return F.lit(True)
    return F.coalesce(quality_column, F.lit(NONE)) >= params.least_quality


def assign_poses(detections: DataFrame, poses: DataFrame, key: str, params: Params = DEFAULTS, crowd: int = CROWD) -> DataFrame:
    """Adds pose_iou, pose_seq and pose_quality of the pose that overlaps a detection most (the first of equal ones).

    Pairs come from :func:`identity_spark.operators.crowd.pairs_in_frames`; the best one is a partial aggregate by detection."""
    p = poses.select("camera_id", "frame_idx", "pose_seq", "quality", boxes.box().alias("_pose"))
    pairs = pairs_in_frames(detections.select("camera_id", "frame_idx", key, boxes.box().alias("_box")), p, "_box", "_pose", crowd)
    pairs = pairs.withColumn("pose_iou", boxes.iou(F.col("_box"), F.col("_pose"))).filter((F.col("pose_iou") > 0) & (F.col("pose_iou") >= params.pose_iou_match_min))
    best = pairs.groupBy("camera_id", "frame_idx", key).agg(F.max_by(F.struct("pose_iou", "pose_seq", F.col("quality").alias("pose_quality")), F.struct("pose_iou", -F.col("pose_seq"))).alias("_best"))
    out = detections.join(best, ["camera_id", "frame_idx", key], "left")
    return out.select(*detections.columns, "_best.*").withColumn("pose_quality", F.coalesce("pose_quality", F.lit(NONE)))


def best_pose(poses: DataFrame, crop: list[str]) -> DataFrame:
    """Quality of the pose of highest score in each crop, the first of equal ones."""
    return poses.groupBy(*crop).agg(F.max_by("quality", F.struct("score", -F.col("pose_seq"))).alias("pose_quality"))


def frame_needs_pose(observations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per frame, whether any track is unknown, not stable yet, or without a known quality.

    observations: known (boolean), stable_count and cached_quality of each track in the frame."""
    need = ~F.col("known") | (F.coalesce("stable_count", F.lit(0)) < params.stable_min_frames) | F.col("cached_quality").isNull()
    return observations.groupBy("camera_id", "frame_idx").agg(F.bool_or(need).alias("needs_pose"))


def last_known_quality(observations: DataFrame) -> DataFrame:
    """Adds cached_quality: the track's latest quality that isn't null, up to the row."""
    track = Window.partitionBy("camera_id", "tracker_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return observations.withColumn("cached_quality", F.last("pose_quality", ignorenulls=True).over(track))
