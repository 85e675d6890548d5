"""Registered queries against the oracle's SQL, at other partition counts, and stream against batch."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from identity_spark.jobs import queries
from identity_spark.jobs.fixtures import Views
from identity_spark.operators.identify import identify
from identity_spark.streaming.identify import dedupe_late, identify_stream, metrics_stream

SF = "/root/testdata/sf0.001"


def rows(names, records):
    return sorted(repr(tuple(round(float(r[c]), 4) if isinstance(r[c], float) else r[c] for c in names)) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(out.columns)
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    clean = lambda r: {k: float(v) if type(v).__name__ == "Decimal" else v for k, v in r.items()}
    number = lambda r: {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in clean(r).items()}
    assert rows(sorted(columns), map(number, want)) == rows(sorted(columns), [number(r.asDict()) for r in out.collect()])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_partitions_change_nothing(spark, name):
    results = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = queries.QUERIES[name](spark, SF)
        results.append(rows(out.columns, [r.asDict() for r in out.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and results[0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_is_as_batch(spark, tmp_path, batches):
    seen = queries.observations(Views(spark, SF)).select("camera_id", "frame_idx", "det_seq", "tracker_id", *("x1", "y1", "x2", "y2"), "pose_quality", "body", "face").cache()
    last = seen.agg(F.max("frame_idx")).first()[0] + 1
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k in range(batches):
        part = seen.filter((F.col("frame_idx") >= last * k // batches) & (F.col("frame_idx") < last * (k + 1) // batches))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in"))
        q = identify_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    done, want = spark.read.parquet(str(tmp_path / "out")), identify(seen)
    assert rows(want.columns, [r.asDict() for r in done.collect()]) == rows(want.columns, [r.asDict() for r in want.collect()])


def test_late_and_repeated_rows(spark, tmp_path):
    t = Views(spark, SF).tracks.withColumns({"global_id": F.col("tracker_id"), "ts": F.col("ts").cast("timestamp")})
    t.unionByName(t).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("once", dedupe_late(stream), "append"), ("windows", metrics_stream(dedupe_late(stream), "1 day", None), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == t.count()
    assert spark.table("windows").agg(F.sum("n_detections")).first()[0] <= t.count()


def test_lookup_stream(spark, tmp_path):
    from identity_spark.streaming.lookup import lookup_stream

    v = Views(spark, SF)
    asked = v.requests.join(v.queries.select("query_id", "body", "face"), "query_id").select(F.lit(0).cast("long").alias("camera_id"), F.concat_ws("@", "request_id", "camera_id").alias("request_id"), "body", "face")
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    none = asked.select("camera_id", "request_id").limit(0)
    active = none.withColumns({"tracker_id": F.lit(0).cast("long"), "global_id": F.lit(0).cast("long"), "det_seq": F.lit(0).cast("long")})
    tables = lambda: {"gallery": v.gallery, "faces": v.face_gallery, "active": active, "confirmed": active, "pending": active.withColumn("embedding", F.array(F.lit(0.0)))}
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    lookup_stream(stream, tables, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = {r["request_id"]: r["method"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == asked.count() and set(out.values()) <= {"gid_only", "none"} and "gid_only" in out.values()


def test_link_tracks_is_as_a_plain_loop(spark):
    """Detections of a frame beside live tracks: all pairs of enough overlap, the best one first, each side once."""
    v = Views(spark, SF)
    found = {(r["camera_id"], r["obs_id"]): r["tracker_id"] for r in queries.QUERIES["t8_link_tracks"](spark, SF).collect()}
    rows = sorted((r.asDict() for r in v.tracks.collect()), key=lambda r: (r["camera_id"], r["frame_idx"], r["obs_id"]))

    def iou(a, b):
        w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
        size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return w * h / (size(a) + size(b) - w * h) if w > 0 and h > 0 else 0.0

    want = {}
    for camera in sorted({r["camera_id"] for r in rows}):
        tracks, number, before = [], 0, None  # a track: its number, last box, last frame
        frames = {}
        for r in rows:
            if r["camera_id"] == camera:
                frames.setdefault(r["frame_idx"], []).append(r)
        for frame, seen in frames.items():
            tracks = [t for t in tracks if frame - t[2] <= 30]
            linked = {}
            for high, least in ((True, 0.2), (False, 0.5)):
                some = [r for r in seen if (r["confidence"] >= 0.5) == high]
                open_tracks = [t for t in tracks if t[0] not in linked.values() and (high or t[2] == before)]
                pairs = sorted(((-iou(r, t[1]), r["obs_id"], t[0]) for r in some for t in open_tracks), key=lambda p: p)
                for minus, obs, track in pairs:
                    if -minus >= least and obs not in linked and track not in linked.values():
                        linked[obs] = track
            for r in seen:
                if r["obs_id"] in linked:
                    next(t for t in tracks if t[0] == linked[r["obs_id"]])[1:] = [r, frame]
                elif r["confidence"] >= 0.5:
                    number += 1
                    linked[r["obs_id"]] = number
                    tracks.append([number, r, frame])
                want[camera, r["obs_id"]] = linked.get(r["obs_id"])
            before = frame
    assert found == want
