"""Streams with keyed state, replayed in different cuts, against the batch operators."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from identity_spark.jobs.replay import replayed
from identity_spark.operators import lookup, tracklets
from identity_spark.streaming import keyed
from identity_spark.streaming.correlate import correlate_stream

T0 = dt.datetime(2024, 1, 1)
END = dt.datetime(2030, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State stores are opened for each partition and batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(s):
    return T0 + dt.timedelta(seconds=s)


def found(df, *columns):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_requests_meet_the_last_response_in_time(spark, cuts):
    asked = spark.createDataFrame([(f"r{k}", k % 3, at(10 * k)) for k in range(30)], "request_id string, camera_id long, ts timestamp")
    answers = [(f"r{k}", k * 10 + n, at(10 * k + 3 + 2 * n)) for k in range(30) if k % 4 for n in range(k % 3 + 1)]
    came = spark.createDataFrame(answers, "request_id string, global_id long, arrived timestamp")
    # one after the bound, one before its request, one of no request
    odd = spark.createDataFrame([("r1", -1, at(10 + 61)), ("r2", -2, at(19)), ("r99", -3, at(50))], came.schema)
    closing = {"asked": spark.createDataFrame([("end", 0, END)], asked.schema), "came": spark.createDataFrame([("end", 0, END)], came.schema)}
    out, _ = replayed({"asked": asked, "came": came.unionByName(odd)}, lambda s: correlate_stream(s["asked"], s["came"], "1 minute", "20 seconds"), {"asked": "ts", "came": "arrived"}, cuts, closing=closing)
    want = lookup.correlate_lookup(asked, came)
    assert found(out.filter("request_id <> 'end'"), "request_id", "camera_id", "global_id") == found(want, "request_id", "camera_id", "global_id")
    assert want.filter("global_id IS NULL").count() == 8


def test_requests_that_wait_have_one_timer():
    """However many wait, the frames and requests of a camera are read once for all that the watermark has passed."""

    class State(list):
        reads = 0

        def get(self):
            self.reads += 1
            return iter(tuple(self))

        def put(self, rows):
            self[:] = rows

        appendValue, appendList = list.append, list.extend

    class Handle:
        timers: set = set()
        getListState = staticmethod(lambda name, schema: State())
        listTimers = staticmethod(lambda: iter(tuple(Handle.timers)))
        registerTimer, deleteTimer = staticmethod(timers.add), staticmethod(timers.discard)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    asked = [(at(k), k, f"r{k}") for k in range(200)]
    taken = [(at(k), k, None) for k in range(50, 300, 2)]
    camera = keyed._AsOf()
    camera.init(Handle)
    list(camera.handleInputRows((7,), iter([pd.DataFrame(asked + taken, columns=["ts", "frame_idx", "request_id"])]), Now(0)))
    first, ms = Handle.timers.copy(), lambda k: keyed._ms(pd.Timestamp(at(k)))
    assert first == {ms(0)}
    camera.frames.reads = 0
    out = []
    for passed in (120, 199):
        (timer,) = Handle.timers
        expired = Now(timer)
        out += list(camera.handleExpiredTimer((7,), Now(ms(passed)), expired))
        Handle.timers.discard(timer)
    assert camera.frames.reads == 2 and not Handle.timers and not camera.waiting
    got = {r.request_id: None if pd.isna(r.active_frame) else r.active_frame for r in pd.concat(out).itertuples()}
    assert got == {f"r{k}": k - k % 2 if k >= 50 else None for k in range(200)}


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_requests_are_answered_as_of_their_time(spark, cuts):
    keyed.use_keyed_state(spark)
    frames = [(c, f, t, at(f)) for c in (0, 1) for f in range(3, 100) if f % (7 + c) > 1 for t in range(3)]
    tracks = spark.createDataFrame(frames, "camera_id long, frame_idx long, tracker_id long, ts timestamp")
    asked = spark.createDataFrame([(c, f"{c}-{f}", f, at(f)) for c in (0, 1, 2) for f in range(0, 110, 5)], "camera_id long, request_id string, frame_idx long, ts timestamp")
    closing = {"tracks": spark.createDataFrame([(9, 0, 0, END)], tracks.schema), "asked": spark.createDataFrame([(9, "end", 0, END)], asked.schema)}
    out, state = replayed({"tracks": tracks, "asked": asked}, lambda s: keyed.active_as_of_stream(s["asked"], s["tracks"], "2 seconds"), {"tracks": "ts", "asked": "ts"}, cuts, closing=closing)
    assert found(out, "camera_id", "request_id", "active_frame") == found(lookup.active_as_of(asked, tracks), "camera_id", "request_id", "active_frame")
    kept = keyed.kept_state(spark, state, "frames")
    assert kept.select("key.camera_id").distinct().count() == kept.count()  # one frame a camera is left
    assert keyed.kept_state(spark, state, "waiting").filter("list_element.request_id <> 'end'").count() == 0


def recording(spark):
    rows = []
    for c in (0, 1):
        for f in range(0, 120):
            if f % 11 == 5:
                continue  # no frame of this camera has this number
            for t in range(5):
                if (f // (4 + t) + t + c) % 3 and not (t == 4 and f > 40):
                    k = f * 5 + t
                    rows.append((c, t, f, at(f), k % 5 != 0, k % 35 == 0, [float(k % 7), 1.0, float(t)], [float(k), 1.0] if k % 3 == 0 else None))
    return spark.createDataFrame(rows, "camera_id long, tracker_id long, frame_idx long, ts timestamp, qualifies boolean, has_face boolean, body array<double>, face array<double>")


def confirmed(seen):
    """The batch form: rows where a run is long enough, with means and faces, and those that a face ends."""
    runs = tracklets.latest_face(tracklets.confirm_points(tracklets.pending_runs(seen)), "face")
    means = tracklets.mean_embeddings(runs, "body").select("camera_id", "tracker_id", F.col("confirm_frame").alias("frame_idx"), "n_embeddings", "mean_embedding")
    body = runs.filter("confirms").join(means, ["camera_id", "tracker_id", "frame_idx"]).select("camera_id", "tracker_id", "frame_idx", F.lit("body").alias("method"), "n_embeddings", F.col("mean_embedding")[0].alias("first"), F.col("latest_face")[0].alias("face"))
    by_face = runs.filter("face_ends_wait").select("camera_id", "tracker_id", "frame_idx", F.lit("face").alias("method"), F.col("seen").alias("n_embeddings"), F.lit(None).cast("double").alias("first"), F.coalesce("face", "latest_face")[0].alias("face"))
    return body.unionByName(by_face)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_tracks_are_confirmed_as_in_batch(spark, cuts):
    keyed.use_keyed_state(spark)
    seen = recording(spark)
    one = spark.createDataFrame([(9, 0, 0, END, False, False, [0.0], None)], seen.schema)
    numbers, _ = replayed({"seen": seen}, lambda s: keyed.number_frames(s["seen"]), {"seen": "ts"}, cuts)
    numbered = tracklets.pending_runs(seen)
    assert found(numbers, "camera_id", "frame_idx", "frame_seq") == found(numbered.select("camera_id", "frame_idx", "frame_seq").distinct(), "camera_id", "frame_idx", "frame_seq")
    rows = seen.join(numbers.select("camera_id", "frame_idx", "frame_seq"), ["camera_id", "frame_idx"])
    closing = {"rows": one.withColumn("frame_seq", F.lit(1).cast("long")).select(rows.columns)}
    out, state = replayed({"rows": rows}, lambda s: keyed.confirm_tracks(s["rows"], lifetime_seconds=60), {"rows": "ts"}, cuts, closing=closing)
    out = out.select("*", F.col("mean_embedding")[0].alias("first"), F.col("latest_face")[0].alias("face_first"))
    want = confirmed(seen)
    names = ["camera_id", "tracker_id", "frame_idx", "method", "n_embeddings", "first"]
    assert found(out, *names, "face_first") == found(want, *names, "face") and want.select("method").distinct().count() == 2
    left = {v: keyed.kept_state(spark, state, v).filter("key.camera_id <> 9").count() for v in ("run", "bodies", "face")}
    assert left == {"run": 0, "bodies": 0, "face": 0}


def test_state_of_tracks_ends_and_identities_stay(spark):
    keyed.use_keyed_state(spark)
    seen = recording(spark).select("camera_id", "tracker_id", "frame_idx", "ts", F.when(F.col("frame_idx") > 20, F.col("tracker_id") % 2).alias("global_id"))
    ended, state = replayed({"seen": seen}, lambda s: keyed.track_ends(s["seen"], "2 seconds", 30), {"seen": "ts"}, 3)
    # the fourth track was last seen at 40, the others go on
    assert found(ended, "camera_id", "tracker_id", "global_id") == [(0, 4, 0), (1, 4, 0)]
    kept = keyed.kept_state(spark, state, "track").select("key.*", "value.*")
    assert found(kept, "camera_id", "tracker_id") == [(c, t) for c in (0, 1) for t in range(4)]
    later = spark.createDataFrame([(9, 0, 0, END, 0)], "camera_id long, tracker_id long, frame_idx long, ts timestamp, global_id long")
    ended, state = replayed({"seen": seen}, lambda s: keyed.track_ends(s["seen"], "2 seconds", 30), {"seen": "ts"}, 2, closing={"seen": later.select(seen.columns)})
    assert found(ended, "camera_id", "tracker_id", "n_rows") == found(seen.groupBy("camera_id", "tracker_id").agg(F.count(F.lit(1)).alias("n_rows")), "camera_id", "tracker_id", "n_rows")
    assert found(keyed.kept_state(spark, state, "track"), "key.camera_id") == [(9,)]
    _, who = replayed({"ended": ended.withColumn("ts", F.timestamp_seconds("last_frame"))}, lambda s: keyed.identities_seen(s["ended"]), {"ended": "ts"}, 2)
    assert found(keyed.kept_state(spark, who, "seen").select("key.*", "value.*"), "camera_id", "global_id", "n_tracks") == [(c, g, 3 - g) for c in (0, 1) for g in (0, 1)]
