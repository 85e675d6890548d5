"""Batch replay of whole recordings: every camera's frames go through the same step as in a stream."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..shared import checkpoint_folder, checkpointed
from .identity import Camera, Seen
from .walk import walked

#: What the step says of a detection, after the camera's number.
RESULT = "frame_idx long, tracker_id long, global_id long, match_score double, match_type string, face_sim double, stable_count long"

#: Rows of a camera that one task sorts. A camera of more goes in segments of whole frames, one after another.
SEGMENT = 500_000


def frame_step(camera: Camera, rows: list[dict]) -> list[tuple]:
    """Rows of one frame, in order, through a camera; a row without a track stands for a frame without detections."""
    vector = lambda v: None if v is None else np.asarray(v, float)
    seen = [Seen(int(r["tracker_id"]), np.array([r["x1"], r["y1"], r["x2"], r["y2"]], float), int(r["pose_quality"]), vector(r["body"]), vector(r["face"])) for r in rows if r["tracker_id"] == r["tracker_id"] and r["tracker_id"] is not None]
    return [(int(rows[0]["frame_idx"]), t, g, float(s), m, f, n) for t, g, s, m, f, n in camera.step(seen)]


def identify(observations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """camera_id and RESULT of every identified detection.

    observations: camera_id, frame_idx, det_seq, tracker_id, x1..y2, pose_quality, body, face. Identities feed back from
    frame to frame, so a camera is the unit of parallel work; its rows stream through in order with a bounded state. Where
    a camera has more rows than SEGMENT, they are written by segments of time, and the state goes from one to the next."""
    names = ["camera_id", "frame_idx", "det_seq", "tracker_id", "x1", "y1", "x2", "y2", "pose_quality", "body", "face"]
    rows = observations.select(*names)
    most = observations.groupBy("camera_id").count().agg(F.max("count")).first()[0] or 0
    if most <= SEGMENT:
        return walked(rows, ["camera_id"], ["frame_idx", "det_seq"], ["frame_idx"], lambda: Camera(params), frame_step, RESULT)
    return _by_segments(rows, -(-most // SEGMENT), params)


def _by_segments(rows: DataFrame, n: int, params: Params) -> DataFrame:
    """As :func:`identify`; each segment's task starts with a row that has the camera's state and ends with one that asks for it."""
    spark, types = rows.sparkSession, dict(rows.dtypes)
    cuts = checkpointed(rows.groupBy("camera_id").agg(F.percentile_approx("frame_idx", [k / n for k in range(1, n)]).alias("_cuts")))
    folder = f"{checkpoint_folder(spark)}/segments-{uuid.uuid4()}"
    segment = F.size(F.filter("_cuts", lambda c: c < F.col("frame_idx")))
    rows.join(F.broadcast(cuts), "camera_id").withColumn("_segment", segment).drop("_cuts").write.partitionBy("_segment").parquet(folder)
    table = spark.read.parquet(folder)

    def step(camera: Camera, rows: list[dict]) -> list[tuple]:
        if rows[0]["_part"] == 0:
            vars(camera).update(vars(pickle.loads(rows[0]["_state"])))
            return []
        if rows[0]["_part"] == 2:
            return [(0, 0, 0, 0.0, "", 0.0, 0, pickle.dumps(camera))]
        return [(*x, None) for x in frame_step(camera, rows)]

    # numbers and not nulls in the marks, so that the columns beside them stay integers
    marked = lambda df, part: df.select("camera_id", *[F.lit(None if "array" in t else 0).cast(t).alias(c) for c, t in types.items() if c != "camera_id"], "_state", F.lit(part).alias("_part"))
    ends = marked(cuts.withColumn("_state", F.lit(None).cast("binary")), 2)
    done: DataFrame | None = None
    parts = []
    for k in range(n):
        now = table.filter(F.col("_segment") == k).select(*types, F.lit(None).cast("binary").alias("_state"), F.lit(1).alias("_part")).unionByName(ends)
        if done is not None:
            now = now.unionByName(marked(done.filter("state IS NOT NULL").select("camera_id", F.col("state").alias("_state")), 0))
        done = checkpointed(walked(now, ["camera_id"], ["_part", "frame_idx", "det_seq"], ["_part", "frame_idx"], lambda: Camera(params), step, f"{RESULT}, state binary"))
        parts.append(done.filter("state IS NULL").drop("state"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
