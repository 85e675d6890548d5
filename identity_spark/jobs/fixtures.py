"""Views that make camera data of the given tables, once in Spark and once in the SQL of the oracle.

Tracks, poses, faces and raw outputs come from events; galleries and queries from embeddings."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "tracks": """
        WITH o AS (SELECT event_id % 3 AS camera_id, event_id div 24 AS frame_idx, user_id % 10 AS tracker_id, min(event_id) AS obs_id, min(ts) AS ts FROM events GROUP BY 1, 2, 3)
        SELECT *, 40D * tracker_id + (obs_id % 5) * 6 AS x1, 20D + (obs_id % 7) * 3 AS y1, 40D * tracker_id + (obs_id % 5) * 6 + 60 AS x2, 20D + (obs_id % 7) * 3 + 150 AS y2,
          0.40D + (obs_id % 60) / 100D AS confidence, obs_id % (SELECT count(*) FROM embeddings) AS vec_id FROM o""",
    "poses": """
        SELECT camera_id, frame_idx, obs_id AS pose_seq, x1 + (obs_id % 4) * 12 AS x1, y1 + 5 AS y1, x2 + (obs_id % 4) * 12 AS x2, y2 + 5 AS y2, 0.30D + (obs_id % 70) / 100D AS score,
          transform(sequence(0, 16), k -> named_struct('x', x1 + k, 'y', y1 + k, 'c', CASE WHEN (obs_id + k * 3) % 11 < 8 THEN 0.9D ELSE 0.2D END)) AS kps
        FROM tracks WHERE obs_id % 6 <> 5""",
    "faces": """
        SELECT camera_id, frame_idx, obs_id AS face_seq, CAST(x1 + 15 + (obs_id % 9) * 5 AS INT) AS x, CAST(y1 + 5 AS INT) AS y, CAST(8 + obs_id % 17 AS INT) AS w, CAST(8 + obs_id % 19 AS INT) AS h,
          0.5D + (obs_id % 50) / 100D AS score, (obs_id * 3 + 1) % (SELECT count(*) FROM embeddings) AS vec_id
        FROM tracks WHERE obs_id % 3 <> 0""",
    "raw_detections": """
        SELECT event_id % 3 AS camera_id, event_id div 24 AS frame_idx, event_id AS query_idx, array(((event_id * 7) % 41 - 20) / 5D, ((event_id * 11) % 37 - 18) / 5D, ((event_id * 13) % 31 - 20) / 5D) AS logits,
          array(((event_id * 17) % 100) / 100D, ((event_id * 19) % 100) / 100D, 0.05D + (event_id % 30) / 100D, 0.10D + (event_id % 40) / 100D) AS box, 640 AS frame_w, 480 AS frame_h FROM events""",
    "raw_faces": """
        SELECT event_id div 200 AS frame_idx, event_id, 8 * shiftleft(1, CAST(event_id % 3 AS INT)) AS stride, (event_id * 31) % ((640 div (8 * shiftleft(1, CAST(event_id % 3 AS INT)))) * (640 div (8 * shiftleft(1, CAST(event_id % 3 AS INT))))) AS anchor_idx,
          ((event_id * 7) % 61 - 30) / 10D AS cls, ((event_id * 11) % 61 - 30) / 10D AS obj, array((event_id % 5) / 5D, (event_id % 7) / 7D, ((event_id % 9) - 2) / 4D, ((event_id % 11) - 3) / 4D) AS bbox,
          array(0.1D, 0.2D, 0.3D, 0.2D, 0.2D, 0.3D, 0.1D, 0.4D, 0.3D, 0.4D) AS kps FROM events""",
    "gallery": """
        SELECT CAST(0 AS BIGINT) AS camera_id, CAST(label AS BIGINT) AS global_id, vec_id AS entry_seq, vec_id * 3 AS frame_idx, transform(embedding, x -> CAST(x AS DOUBLE)) AS embedding,
          CAST(vec_id % 2 + 1 AS INT) AS pose_quality, vec_id % 2 = 0 AS has_face FROM embeddings WHERE label < 9 AND vec_id % 50 <> 0""",
    "face_gallery": """
        SELECT CAST(0 AS BIGINT) AS camera_id, CAST(label AS BIGINT) AS global_id, vec_id AS entry_seq, vec_id * 3 AS frame_idx, transform(slice(embedding, 1, 32), x -> CAST(x AS DOUBLE)) AS embedding
        FROM embeddings WHERE label % 4 <> 0 AND vec_id % 3 = 0""",
    "queries": """
        WITH b AS (SELECT a.vec_id AS query_id, a.label AS true_gid, zip_with(a.embedding, b.embedding, (x, y) -> 0.9D * x + 0.3D * y) AS body
          FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))
        SELECT CAST(0 AS BIGINT) AS camera_id, *, CASE WHEN query_id % 3 <> 2 THEN slice(body, 1, 32) END AS face FROM b""",
    "kp_matches": "SELECT (l_orderkey * l_orderkey) % 40 AS crop_a, l_orderkey % 17 AS crop_b, l_partkey % 1024 AS kp0, l_suppkey AS kp1 FROM lineitem",
    "requests": "SELECT camera_id, CAST(frame_idx AS STRING) AS request_id, frame_idx, min(vec_id) AS query_id FROM tracks WHERE frame_idx % 10 = 0 GROUP BY 1, 2, 3",
    "body_candidates": """
        SELECT t.camera_id, t.tracker_id AS global_id, t.frame_idx, t.obs_id, CAST(t.obs_id % 3 AS INT) AS pose_quality, zip_with(a.embedding, b.embedding, (x, y) -> 0.9D * x + 0.3D * y) AS embedding
        FROM tracks t JOIN embeddings a ON a.vec_id = t.vec_id - t.vec_id % 25 JOIN embeddings b ON b.vec_id = t.vec_id""",
    "split_gallery": """
        SELECT camera_id, global_id, entry_seq, embedding FROM gallery
        UNION ALL SELECT CAST(0 AS BIGINT), CAST(a.label + 100 AS BIGINT), a.vec_id, zip_with(a.embedding, b.embedding, (x, y) -> 0.95D * x + 0.1D * y)
        FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) WHERE a.label < 5""",
}

ORACLE = {
    "tracks": """
        WITH o AS (SELECT event_id % 3 AS camera_id, event_id // 24 AS frame_idx, user_id % 10 AS tracker_id, min(event_id) AS obs_id, min(ts) AS ts FROM events GROUP BY 1, 2, 3)
        SELECT *, CAST(40 * tracker_id + (obs_id % 5) * 6 AS DOUBLE) AS x1, CAST(20 + (obs_id % 7) * 3 AS DOUBLE) AS y1, CAST(40 * tracker_id + (obs_id % 5) * 6 + 60 AS DOUBLE) AS x2, CAST(20 + (obs_id % 7) * 3 + 150 AS DOUBLE) AS y2,
          CAST(0.40 AS DOUBLE) + (obs_id % 60) / CAST(100 AS DOUBLE) AS confidence, obs_id % (SELECT count(*) FROM embeddings) AS vec_id FROM o""",
    "poses": """
        SELECT camera_id, frame_idx, obs_id AS pose_seq, x1 + (obs_id % 4) * 12 AS x1, y1 + 5 AS y1, x2 + (obs_id % 4) * 12 AS x2, y2 + 5 AS y2, CAST(0.30 AS DOUBLE) + (obs_id % 70) / CAST(100 AS DOUBLE) AS score,
          list_transform(range(17), lambda k: {'x': x1 + k, 'y': y1 + k, 'c': CASE WHEN (obs_id + k * 3) % 11 < 8 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END}) AS kps
        FROM tracks WHERE obs_id % 6 <> 5""",
    "faces": """
        SELECT camera_id, frame_idx, obs_id AS face_seq, CAST(x1 + 15 + (obs_id % 9) * 5 AS INT) AS x, CAST(y1 + 5 AS INT) AS y, CAST(8 + obs_id % 17 AS INT) AS w, CAST(8 + obs_id % 19 AS INT) AS h,
          CAST(0.5 AS DOUBLE) + (obs_id % 50) / CAST(100 AS DOUBLE) AS score, (obs_id * 3 + 1) % (SELECT count(*) FROM embeddings) AS vec_id FROM tracks WHERE obs_id % 3 <> 0""",
    "raw_detections": """
        SELECT event_id % 3 AS camera_id, event_id // 24 AS frame_idx, event_id AS query_idx, [((event_id * 7) % 41 - 20) / CAST(5 AS DOUBLE), ((event_id * 11) % 37 - 18) / CAST(5 AS DOUBLE), ((event_id * 13) % 31 - 20) / CAST(5 AS DOUBLE)] AS logits,
          [((event_id * 17) % 100) / CAST(100 AS DOUBLE), ((event_id * 19) % 100) / CAST(100 AS DOUBLE), CAST(0.05 AS DOUBLE) + (event_id % 30) / CAST(100 AS DOUBLE), CAST(0.10 AS DOUBLE) + (event_id % 40) / CAST(100 AS DOUBLE)] AS box, 640 AS frame_w, 480 AS frame_h FROM events""",
    "raw_faces": """
        SELECT event_id // 200 AS frame_idx, event_id, 8 * (1 << CAST(event_id % 3 AS INT)) AS stride, CAST((event_id * 31) % ((640 // (8 * (1 << CAST(event_id % 3 AS INT)))) * (640 // (8 * (1 << CAST(event_id % 3 AS INT))))) AS BIGINT) AS anchor_idx,
          ((event_id * 7) % 61 - 30) / CAST(10 AS DOUBLE) AS cls, ((event_id * 11) % 61 - 30) / CAST(10 AS DOUBLE) AS obj, [(event_id % 5) / CAST(5 AS DOUBLE), (event_id % 7) / CAST(7 AS DOUBLE), ((event_id % 9) - 2) / CAST(4 AS DOUBLE), ((event_id % 11) - 3) / CAST(4 AS DOUBLE)] AS bbox FROM events""",
    "gallery": """
        SELECT CAST(0 AS BIGINT) AS camera_id, CAST(label AS BIGINT) AS global_id, vec_id AS entry_seq, vec_id * 3 AS frame_idx, CAST(embedding AS DOUBLE[]) AS embedding,
          CAST(vec_id % 2 + 1 AS INT) AS pose_quality, vec_id % 2 = 0 AS has_face FROM embeddings WHERE label < 9 AND vec_id % 50 <> 0""",
    "face_gallery": "SELECT CAST(0 AS BIGINT) AS camera_id, CAST(label AS BIGINT) AS global_id, vec_id AS entry_seq, vec_id * 3 AS frame_idx, CAST(embedding[1:32] AS DOUBLE[]) AS embedding FROM embeddings WHERE label % 4 <> 0 AND vec_id % 3 = 0",
    "queries": """
        WITH b AS (SELECT a.vec_id AS query_id, a.label AS true_gid, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(0.9 AS DOUBLE) * CAST(z[1] AS DOUBLE) + CAST(0.3 AS DOUBLE) * CAST(z[2] AS DOUBLE)) AS body
          FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))
        SELECT CAST(0 AS BIGINT) AS camera_id, *, CASE WHEN query_id % 3 <> 2 THEN body[1:32] END AS face FROM b""",
    "kp_matches": "SELECT (l_orderkey * l_orderkey) % 40 AS crop_a, l_orderkey % 17 AS crop_b, l_partkey % 1024 AS kp0, l_suppkey AS kp1 FROM lineitem",
    "requests": "SELECT camera_id, CAST(frame_idx AS VARCHAR) AS request_id, frame_idx, min(vec_id) AS query_id FROM tracks WHERE frame_idx % 10 = 0 GROUP BY 1, 2, 3",
    "body_candidates": """
        SELECT t.camera_id, t.tracker_id AS global_id, t.frame_idx, t.obs_id, CAST(t.obs_id % 3 AS INT) AS pose_quality,
          list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(0.9 AS DOUBLE) * CAST(z[1] AS DOUBLE) + CAST(0.3 AS DOUBLE) * CAST(z[2] AS DOUBLE)) AS embedding
        FROM tracks t JOIN embeddings a ON a.vec_id = t.vec_id - t.vec_id % 25 JOIN embeddings b ON b.vec_id = t.vec_id""",
    "split_gallery": """
        SELECT camera_id, global_id, entry_seq, embedding FROM gallery
        UNION ALL SELECT CAST(0 AS BIGINT), CAST(a.label + 100 AS BIGINT), a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(0.95 AS DOUBLE) * CAST(z[1] AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(z[2] AS DOUBLE))
        FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) WHERE a.label < 5""",
}


def oracle(sql: str) -> str:
    """``sql`` with the views that it names before it."""
    wanted: list[str] = []

    def need(text: str, of: str = "") -> None:
        for name in ORACLE:
            if name != of and name not in wanted and re.search(rf"\b{name}\b", text):
                need(ORACLE[name], name)
                wanted.append(name)

    need(sql)
    views = ",\n".join(f"{n} AS ({ORACLE[n]})" for n in wanted)
    own = sql.lstrip()
    if not views:
        return own
    recursive = own.upper().startswith("WITH RECURSIVE")
    if own.upper().startswith("WITH"):
        own = ",\n" + own[len("WITH RECURSIVE" if recursive else "WITH") :]
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{own}"


def overlap_sql(a: str, b: str) -> str:
    """IoU of two boxes of the oracle, whose columns have these prefixes."""
    w = f"greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    size = lambda p: f"(({p}x2 - {p}x1) * ({p}y2 - {p}y1))"
    return f"(CASE WHEN {w} * {h} = 0 THEN 0.0 ELSE {w} * {h} / ({size(a)} + {size(b)} - {w} * {h}) END)"


class Views:
    """The views over one folder of tables, each made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in SPARK:
            names = [n for n in (*SPARK, "events", "embeddings", "lineitem") if any(f"{w} {n}" in " ".join(SPARK[name].split()) for w in ("FROM", "JOIN"))]
            df = self.spark.sql(" ".join(SPARK[name].split()) if not names else _with_tables(SPARK[name], names), **{n: getattr(self, n) for n in names})
        else:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df

    @cached_property
    def det(self) -> DataFrame:
        """Tracks with their number in the frame as det_seq."""
        return self.tracks.withColumnRenamed("obs_id", "det_seq")


def _with_tables(sql: str, names: list[str]) -> str:
    """Names after FROM and JOIN as parameters that take a DataFrame."""
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b(?!\s*\()", rf"\1 {{{n}}}", sql)
    return sql
