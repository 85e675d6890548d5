"""Faces of a frame and the persons they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from .crowd import CROWD, pairs_in_frames, point


def assign_faces(detections: DataFrame, faces: DataFrame, key: str, crowd: int = CROWD) -> DataFrame:
    """Adds face_seq and face_area of the largest face whose centre is in the whole-pixel box, edges included.

    Equal areas: the first face. A face may serve several persons."""
    c = boxes.face_centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    f = faces.select("camera_id", "frame_idx", "face_seq", c.alias("_centre"), (F.col("w") * F.col("h")).alias("face_area"))
    d = detections.select("camera_id", "frame_idx", key, boxes.truncated(boxes.box()).alias("_box"))
    inside = F.col("_centre.x").between(F.col("_box.x1"), F.col("_box.x2")) & F.col("_centre.y").between(F.col("_box.y1"), F.col("_box.y2"))
    pairs = pairs_in_frames(d, f.withColumn("_point", point(F.col("_centre"))), "_box", "_point", crowd).filter(inside)
    best = pairs.groupBy("camera_id", "frame_idx", key).agg(F.max_by(F.struct("face_seq", "face_area"), F.struct("face_area", -F.col("face_seq"))).alias("_best"))
    return detections.join(best, ["camera_id", "frame_idx", key], "left").select(*detections.columns, "_best.*")
