"""Boxes of crowded frames against all pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from identity_spark.functions import boxes
from identity_spark.operators import crowd
from identity_spark.operators.faces import assign_faces
from identity_spark.operators.pose import assign_poses


def scene(spark, n, seed):
    """A crowded frame, an uncrowded one, boxes of all sizes, boxes on each other's edges, broken and null ones."""
    return spark.sql(f"""
        WITH r AS (SELECT id, abs(hash(id, {seed})) AS h FROM range({n}))
        SELECT CAST(h % 2 AS BIGINT) AS camera_id, CASE WHEN id % 10 = 0 THEN 7L ELSE 3L END AS frame_idx, id AS seq, CAST(h % 1900 AS DOUBLE) AS x1, CAST(h div 7 % 1000 AS DOUBLE) AS y1,
          CASE WHEN id % 97 = 5 THEN h % 1900 - 9D WHEN id % 89 = 7 THEN NULL WHEN id % 83 = 1 THEN 1900D ELSE CAST(h % 1900 AS DOUBLE) + h % 40 END AS x2, CAST(h div 7 % 1000 AS DOUBLE) + h div 11 % 60 AS y2
        FROM r""")


@pytest.mark.parametrize("n", [0, 900])
def test_crowded_frames_give_the_same_rows(spark, n):
    seen = scene(spark, n, 1).withColumnRenamed("seq", "obs_id")
    poses = scene(spark, n, 2).withColumnsRenamed({"seq": "pose_seq"}).withColumn("quality", F.col("pose_seq") % 3)
    faces = scene(spark, n, 3).selectExpr("camera_id", "frame_idx", "seq AS face_seq", "CAST(x1 AS INT) AS x", "CAST(y1 AS INT) AS y", "CAST(9 + seq % 5 AS INT) AS w", "CAST(9 + seq % 7 AS INT) AS h")
    rows = lambda df: sorted(map(str, df.collect()))
    few, many = (rows(assign_poses(seen, poses, "obs_id", crowd=c)) for c in (10, 10**6))
    assert few == many and len(few) == n
    few, many = (rows(assign_faces(seen, faces, "obs_id", crowd=c)) for c in (10, 10**6))
    assert few == many and len(few) == n
    if n:
        assert sum("face_seq=None" not in r for r in few) > 20


def test_a_crowd_isn_t_paired(spark):
    seen = scene(spark, 8000, 1).select("camera_id", "frame_idx", "seq", boxes.box().alias("_a"))
    other = scene(spark, 8000, 2).select("camera_id", "frame_idx", F.col("seq").alias("other"), boxes.box().alias("_b"))
    pairs = crowd.pairs_in_frames(seen, other, "_a", "_b", 100)
    every = sum(r["n"] ** 2 for r in seen.groupBy("camera_id", "frame_idx").agg(F.count(F.lit(1)).alias("n")).collect())
    overlap = pairs.filter(boxes.iou(F.col("_a"), F.col("_b")) > 0).count()
    assert 0 < overlap <= pairs.count() < every / 50
    assert pairs.select("seq", "other").distinct().count() == pairs.count()
    meeting = [x for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "_cx" in x]
    assert meeting and all("_cy" in x for x in meeting)
