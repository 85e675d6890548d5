"""Registered queries of the streams: the views are replayed in parts by event time, and the SQL is that of the batch form.

A frame's number is its second, and rows that come last of all let the watermark pass. Time begins a day after the
epoch, as a stream's first watermark is the epoch itself."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint_folder
from ..streaming import keyed
from ..streaming.correlate import correlate_stream
from ..streaming.identify import dedupe_late
from ..streaming.lookup import lookup_stream, track_messages
from . import folds
from .fixtures import Views
from .queries import RUNS_SQL, asked_in_frames, registered, rounded, runs, track_json
from .replay import replayed

END = dt.datetime(2100, 1, 1)
#: Of the rows that close a replay.
NO_CAMERA = -1


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 86_400))


def closing(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row of the table's columns, of no camera and a late time; all else is null."""
    own = {"camera_id": F.lit(NO_CAMERA), "frame_idx": F.lit(0), "tracker_id": F.lit(0), "frame_seq": F.lit(1), "qualifies": F.lit(False), "has_face": F.lit(False), "request_id": F.lit("end"), ts: F.lit(END)}
    return df.sparkSession.range(1).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


@registered("""
    WITH q AS (SELECT *, CAST(camera_id AS VARCHAR) || '@' || request_id AS id FROM requests),
    a AS (SELECT id, query_id % 5 AS global_id, 2 AS later FROM q WHERE query_id % 6 <> 0 UNION ALL SELECT id, query_id % 7, 5 FROM q WHERE query_id % 4 = 1)
    SELECT q.id AS request_id, q.camera_id, x.global_id FROM q LEFT JOIN (SELECT id, arg_max(global_id, later) AS global_id FROM a GROUP BY 1) x USING (id)
""")
def j16_correlate_stream(v: Views) -> DataFrame:
    """Answers come after two seconds, second ones after five; those after two minutes are too late to count."""
    own = F.concat(F.col("camera_id").cast("string"), F.lit("@"), F.col("request_id"))
    asked = timed(v.requests.select(own.alias("request_id"), "camera_id", "frame_idx", "query_id"))
    answer = lambda when, gid, later: asked.filter(when).select("request_id", F.expr(gid).alias("global_id"), (F.col("ts") + F.expr(f"INTERVAL {later} SECONDS")).alias("arrived"))
    came = answer("query_id % 6 <> 0", "query_id % 5", 2).unionByName(answer("query_id % 4 = 1", "query_id % 7", 5)).unionByName(answer("query_id % 3 = 0", "CAST(-1 AS BIGINT)", 120))
    asked = asked.drop("frame_idx", "query_id")
    out, _ = replayed({"asked": asked, "came": came}, lambda s: correlate_stream(s["asked"], s["came"], "1 minute", "10 seconds"), {"asked": "ts", "came": "arrived"}, closing={"asked": closing(asked), "came": closing(came, "arrived")})
    return out.filter(F.col("camera_id") != NO_CAMERA).select("request_id", "camera_id", "global_id")


@registered("""
    SELECT r.camera_id, r.request_id, max(t.frame_idx) AS active_frame FROM requests r LEFT JOIN (SELECT DISTINCT camera_id, frame_idx FROM tracks WHERE frame_idx % 7 <> 0) t
    ON t.camera_id = r.camera_id AND t.frame_idx <= r.frame_idx GROUP BY 1, 2
""")
def j12_active_as_of_stream(v: Views) -> DataFrame:
    keyed.use_keyed_state(v.spark)
    tables = {"asked": timed(v.requests.drop("query_id")), "tracks": timed(v.tracks.filter("frame_idx % 7 <> 0").select("camera_id", "frame_idx", "tracker_id"))}
    out, _ = replayed(tables, lambda s: keyed.active_as_of_stream(s["asked"], s["tracks"], "5 seconds"), dict.fromkeys(tables, "ts"), closing={n: closing(t) for n, t in tables.items()})
    return out.filter(F.col("camera_id") != NO_CAMERA)


@registered(f"""
    WITH {RUNS_SQL}, e AS (SELECT camera_id, tracker_id, run, frame_idx AS confirm_frame FROM k WHERE seen >= 5 AND face = 0 AND done = 0),
    x AS (SELECT e.*, unnest(range(1, 65)) AS d, unnest(b.embedding) AS y FROM e JOIN k USING (camera_id, tracker_id, run) JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.qualifies AND k.frame_idx <= e.confirm_frame),
    m AS (SELECT camera_id, tracker_id, run, confirm_frame, d, avg(CAST(y AS DOUBLE)) AS y, count(*) AS n FROM x GROUP BY ALL)
    SELECT camera_id, tracker_id, confirm_frame AS frame_idx, 'body' AS method, CAST(min(n) AS BIGINT) AS n_embeddings, round(max(CASE WHEN d = 1 THEN y END) / sqrt(sum(y * y)), 4) AS first FROM m GROUP BY camera_id, tracker_id, run, confirm_frame
    UNION ALL SELECT camera_id, tracker_id, frame_idx, 'face', CAST(seen AS BIGINT), NULL FROM k WHERE face = 1 AND seen < 5 AND done = 0
""")
def t4_confirm_stream(v: Views) -> DataFrame:
    """Frames are numbered by one stream and tracks confirmed by another."""
    keyed.use_keyed_state(v.spark)
    body = v.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("body"))
    seen = timed(runs(v).select("camera_id", "tracker_id", "frame_idx", "qualifies", "has_face", "vec_id").join(body, "vec_id").drop("vec_id")).withColumn("face", F.slice("body", 1, 32))
    frames = seen.select("camera_id", "frame_idx", "ts").distinct()
    numbers, _ = replayed({"frames": frames}, lambda s: keyed.number_frames(s["frames"]), {"frames": "ts"})
    rows = seen.join(numbers.select("camera_id", "frame_idx", "frame_seq"), ["camera_id", "frame_idx"])
    out, _ = replayed({"rows": rows}, lambda s: keyed.confirm_tracks(s["rows"]), {"rows": "ts"}, closing={"rows": closing(rows)})
    return out.filter(F.col("camera_id") != NO_CAMERA).select("camera_id", "tracker_id", "frame_idx", "method", "n_embeddings", rounded("first", F.element_at("mean_embedding", 1), 4))


@registered("""
    WITH t AS (SELECT camera_id, tracker_id, frame_idx FROM tracks WHERE (frame_idx // 40 + tracker_id) % 3 <> 0),
    g AS (SELECT *, sum((coalesce(gap, 0) > 30)::INT) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS spell FROM (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS gap FROM t) x),
    s AS (SELECT camera_id, tracker_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_rows FROM g GROUP BY camera_id, tracker_id, spell)
    SELECT camera_id, tracker_id, first_frame, last_frame, n_rows, last_frame + 30 > (SELECT max(frame_idx) - 2 FROM t) AS is_kept FROM s
""")
def t6_track_ends(v: Views) -> DataFrame:
    """Spells of presence: those that have ended come out of the stream, the others are read from its state."""
    keyed.use_keyed_state(v.spark)
    seen = timed(v.tracks.filter("(frame_idx div 40 + tracker_id) % 3 <> 0").select("camera_id", "tracker_id", "frame_idx", F.col("tracker_id").alias("global_id")))
    ended, state = replayed({"seen": seen}, lambda s: keyed.track_ends(s["seen"], "2 seconds", 30), {"seen": "ts"})
    kept = keyed.kept_state(v.spark, state, "track").select("key.*", "value.*")
    names = ["camera_id", "tracker_id", "first_frame", "last_frame", "n_rows"]
    return ended.select(*names, F.lit(False).alias("is_kept")).unionByName(kept.select(*names, F.lit(True).alias("is_kept")))


@registered("SELECT camera_id, frame_idx, tracker_id FROM tracks")
def t9_dedupe_late(v: Views) -> DataFrame:
    """Rows that come twice, a third of them in a later part, count once."""
    seen = timed(v.tracks.select("camera_id", "frame_idx", "tracker_id")).withColumn("sent", F.col("ts"))
    again = seen.filter("frame_idx % 2 = 0").withColumn("sent", F.when(F.col("frame_idx") % 3 == 0, F.col("ts") + F.expr("INTERVAL 5 SECONDS")).otherwise(F.col("ts")))
    both = seen.unionByName(again)
    out, _ = replayed({"both": both}, lambda s: dedupe_late(s["both"].drop("sent"), "20 seconds"), {"both": "sent"})
    return out.select("camera_id", "frame_idx", "tracker_id")


@registered(folds.REFERENCE)
def t7_lookup_stream(v: Views) -> DataFrame:
    """The lookups of J11 as a stream of requests, against tables that each batch asks for."""
    asked, active, waiting = asked_in_frames(v)
    root = f"{checkpoint_folder(v.spark)}/lookups-{uuid.uuid4().hex}"
    tables = lambda: {"gallery": v.gallery, "faces": v.face_gallery, "active": active, "confirmed": active, "pending": waiting}
    for part in (F.length("request_id") <= 4, F.length("request_id") > 4):
        asked.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = v.spark.readStream.schema(asked.schema).parquet(f"{root}/in")
        lookup_stream(stream, tables, f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = v.spark.read.parquet(f"{root}/out")
    return found.select("request_id", "global_id", "track_id", rounded("score"), "method")


@registered("SELECT camera_id, frame_idx % 50 = 3 AS is_bad, count(DISTINCT frame_idx) AS n FROM tracks GROUP BY 1, 2")
def s2_dead_letters(v: Views) -> DataFrame:
    """Track messages in a stream: good ones as rows, broken ones as text in a folder of their own."""
    root = f"{checkpoint_folder(v.spark)}/messages-{uuid.uuid4().hex}"
    text = track_json(v).select("camera_id", "value")
    text.write.parquet(f"{root}/in")
    stream = v.spark.readStream.schema(text.schema).parquet(f"{root}/in")
    track_messages(stream, f"{root}/rows", f"{root}/bad", keep=["camera_id"]).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    good = v.spark.read.parquet(f"{root}/rows").groupBy("camera_id").agg(F.count_distinct("frame_idx").alias("n"))
    # a broken message is half of one, and the fixture's have their camera in no field
    broken = v.spark.read.text(f"{root}/bad").join(text, "value").groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"))
    return good.select("camera_id", F.lit(False).alias("is_bad"), "n").unionByName(broken.select("camera_id", F.lit(True).alias("is_bad"), "n"))
