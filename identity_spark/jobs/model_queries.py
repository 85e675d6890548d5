"""Registered queries of the operators that run a caller's model, with plain models that SQL can state as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import infer
from .fixtures import Views
from .queries import registered


def four_numbers() -> infer.Model:
    """The first four components, in reverse; it fails on a batch in which a vector begins with more than 0.2."""

    def run(crops: list) -> list:
        if any(c[0] > 0.2 for c in crops):
            raise ValueError("too bright")
        return [c[3::-1] for c in crops]

    return run


@registered("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings), u AS (SELECT vec_id, vec_id % 11 <> 0 AND c[1] <= 0.2 AS fits, vec_id % 11 <> 0 AND c[1] > 0.2 AS failed, c, sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3] + c[4] * c[4]) AS l FROM e)
    SELECT vec_id, CASE WHEN fits THEN round(c[4] / l, 5) END AS first, CASE WHEN fits THEN round(c[1] / l, 5) END AS last, CASE WHEN failed THEN 'ValueError: too bright' END AS error FROM u
""")
def x1_embed_table(v: Views) -> DataFrame:
    """A crop that the model fails on has no embedding, whatever batch it is in; nor has one that is null."""
    crops = v.embeddings.select("vec_id", F.when(F.col("vec_id") % 11 != 0, F.transform("embedding", lambda x: x.cast("double"))).alias("crop"))
    made = infer.embed_table(crops, {"four": four_numbers}, "four", errors="error", batch_bytes=20_000)
    return made.select("vec_id", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.col("embedding")[3], 5).alias("last"), "error")


def some_poses() -> infer.Model:
    """As many poses as the frame's first number says modulo 3, each a pixel further right."""
    return lambda frames: [[{"x1": f[0] + k, "y1": f[1], "x2": f[2] + k, "y2": f[3], "score": 0.5 + k / 10, "kps": [{"x": f[0], "y": f[1], "c": 0.9}] * 17} for k in range(int(f[0]) % 3)] for f in frames]


@registered("""
    SELECT obs_id, CAST(k AS INTEGER) AS pose_seq, x1 + k AS x1, x2 + k AS x2, round(0.5 + k / 10, 5) AS score, 17 AS n_points FROM tracks, range(3) AS r(k) WHERE k < CAST(x1 AS INTEGER) % 3 AND obs_id % 9 <> 4
""")
def x2_pose_table(v: Views) -> DataFrame:
    """Poses of frames; every ninth frame is missing and has none."""
    frames = v.tracks.select("obs_id", F.when(F.col("obs_id") % 9 != 4, F.array("x1", "y1", "x2", "y2")).alias("frame"))
    return infer.pose_table(frames, {"some": some_poses}, "some").select("obs_id", "pose_seq", "x1", "x2", F.round("score", 5).alias("score"), F.size("kps").alias("n_points"))


def two_faces() -> infer.Model:
    """Two faces where the frame's second number is even, none else."""
    return lambda frames: [[{"x1": f[0], "y1": f[1], "x2": f[0] + 20.0 + k, "y2": f[1] + 20.0, "score": 0.9 - k / 5, "embedding": [f[0], float(k), 1.0]} for k in (0, 1) if int(f[1]) % 2 == 0] for f in frames]


@registered("""
    SELECT obs_id, CAST(k AS INTEGER) AS face_seq, x1 + 20 + k AS x2, round(0.9 - k / 5, 5) AS score, x1 + k + 1 AS total FROM tracks, range(2) AS r(k) WHERE CAST(y1 AS INTEGER) % 2 = 0
""")
def x3_face_table(v: Views) -> DataFrame:
    """Faces of frames with their embeddings."""
    found = infer.face_table(v.tracks.select("obs_id", F.array("x1", "y1").alias("frame")), {"two": two_faces}, "two")
    return found.select("obs_id", "face_seq", "x2", F.round("score", 5).alias("score"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))
