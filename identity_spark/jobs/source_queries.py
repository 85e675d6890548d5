"""Registered queries of the stores: recordings by frame, logs by line, crops by version, and tracks in buckets. Each is
written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, tracklets
from ..shared import checkpoint_folder
from ..sources import crops, messages, recorded, sinks
from . import layout
from .fixtures import Views
from .queries import CAM, RUNS_SQL, W1_SQL, registered, track_json, track_map


def folder(v: Views, name: str) -> str:
    """A new one that all executors see."""
    return f"{checkpoint_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@registered("""
    SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx) - 1 AS frame_idx, 4 + length(CAST(frame_idx AS VARCHAR)) + CAST(n AS INTEGER) * 9 AS n_bytes
    FROM (SELECT camera_id, frame_idx, count(*) AS n FROM tracks GROUP BY 1, 2) x
""")
def s11_recorded_frames(v: Views) -> DataFrame:
    """A recording a camera, read in ranges of 5,000 bytes. A picture is its frame's number and a mark for each track."""
    body = F.concat(F.col("frame_idx").cast("string"), F.repeat(F.lit("  track  "), F.col("n").cast("int"))).cast("binary")
    frames = v.tracks.groupBy(*CAM).agg(F.count(F.lit(1)).alias("n")).select(*CAM, F.concat(F.lit(recorded.FIRST), body, F.lit(recorded.LAST)).alias("frame"))
    path = folder(v, "recording")
    recorded.write_recording(frames, path).count()
    read = recorded.numbered_frames(recorded.read_recorded(v.spark, path, split_bytes=5_000))
    return read.select(F.regexp_extract("path", r"camera=(\d+)\.mjpeg$", 1).cast("long").alias("camera_id"), "frame_idx", F.length("frame").alias("n_bytes"))


@registered("""
    SELECT frame_idx, tracker_id, CAST(x1 AS INT) AS x1, round(confidence, 5) AS confidence FROM tracks WHERE frame_idx % 50 <> 3 AND frame_idx % 20 <> 7
    UNION ALL SELECT frame_idx, NULL, NULL, NULL FROM (SELECT DISTINCT camera_id, frame_idx FROM tracks WHERE frame_idx % 50 <> 3 AND frame_idx % 20 = 7) x
""")
def s1_read_message_log(v: Views) -> DataFrame:
    """Track messages from log files, read in ranges of 20,000 bytes."""
    path = folder(v, "log")
    sinks.write_messages(track_json(v), path)
    rows = messages.read_track_messages(recorded.read_recorded(v.spark, path, "lines", split_bytes=20_000))
    return rows.select("frame_idx", "tracker_id", "x1", F.round("confidence", 5).alias("confidence"))


@registered("SELECT camera, global_id, count(*) AS n_crops, CAST(sum(frame_idx) AS BIGINT) AS frames, CASE WHEN camera = 0 THEN 3 ELSE 2 END AS version FROM (SELECT entry_seq % 3 AS camera, * FROM gallery) g WHERE entry_seq % 7 <> 0 AND (camera <> 0 OR entry_seq % 5 <> 0) GROUP BY camera, global_id")
def s10_crop_store(v: Views) -> DataFrame:
    """Crops of three cameras come in two parts; then the first camera loses those of a fifth of its entries."""
    entries = v.gallery.select((F.col("entry_seq") % 3).alias("camera_id"), "global_id", "frame_idx", "entry_seq", F.lit("body").alias("kind"))
    path = sinks.crop_path("/crops", F.col("global_id"), F.col("frame_idx"))
    rows = entries.withColumns({"crop_path": path, "crop": F.when(F.col("entry_seq") % 7 != 0, F.col("entry_seq").cast("string").cast("binary"))})
    store = crops.CropStore(v.spark, folder(v, "crops"))
    store.add(rows.filter("entry_seq % 2 = 0"))
    store.add(rows.filter("entry_seq % 2 = 1"))
    store.prune(rows.filter("camera_id <> 0 OR entry_seq % 5 <> 0"))
    first = store.versions.filter("part IS NOT NULL").groupBy("part", "camera_id").agg(F.min("version").alias("version"))
    since = first.groupBy(F.col("camera_id").alias("camera")).agg(F.max("version").alias("version"))
    kept = store.read().groupBy(F.col("camera_id").alias("camera"), "global_id").agg(F.count(F.lit(1)).alias("n_crops"), F.sum("frame_idx").alias("frames"))
    return kept.join(since, "camera")


@registered(f"""
    WITH {W1_SQL}, {RUNS_SQL.strip()},
    s AS (SELECT *, coalesce(frame_idx > 20 AND prev_iou >= 0.7, false) AS still FROM i),
    g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS island FROM s),
    w AS (SELECT obs_id, CAST(sum(still::INT) OVER (PARTITION BY camera_id, tracker_id, island ORDER BY frame_idx) AS BIGINT) AS stable_count FROM g)
    SELECT k.obs_id, k.run, CAST(k.seen AS BIGINT) AS seen, k.seen >= 5 AND k.face = 0 AND k.done = 0 AS confirms, w.stable_count,
      CASE WHEN (k.camera_id + k.tracker_id) % 4 <> 0 THEN k.tracker_id * 3 % 7 ELSE -1 END AS global_id FROM k JOIN w USING (obs_id)
""")
def w_tracks_in_layout(v: Views) -> DataFrame:
    """W1 to W4 and J13 over tracks that are stored by track: with the last join, all in their buckets."""
    marked = layout.numbered(v.tracks).withColumns({"qualifies": F.col("obs_id") % 7 != 0, "has_face": F.col("obs_id") % 28 == 0})
    name = f"tracks_{uuid.uuid4().hex}"
    stored = layout.write_by_track(marked, name, folder(v, "tracks"), 8)
    who = layout.write_by_track(track_map(v), f"{name}_map", folder(v, "map"), 8)
    runs = tracklets.confirm_points(tracklets.pending_runs(stored))
    still = tracklets.stable_count(tracklets.prev_bbox_iou(runs).withColumn("known_before", F.col("frame_idx") > 20))
    return assign.enrich_tracks(still, who).select("obs_id", F.col("run").cast("long").alias("run"), "seen", "confirms", "stable_count", "global_id")
