"""Streams with typed state by key: frame numbers, confirmation of tracks, lookups as of their time, ends of tracks.

All need a RocksDB state store (:func:`use_keyed_state`) and output mode "append". State goes when it can't matter any
more: a track's when it hasn't been seen for a given time, a camera's frames when no request can ask for them. Times are
event times, so a replay of old recordings forgets as the live stream did. Rows that come behind the watermark are
dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import DEFAULTS, Params

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB; running ones and their checkpoints stay as they are."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000 if ts.unit == "ns" else int(ts.timestamp() * 1000)


def _in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(by), kind="stable")


class _Numbers(StatefulProcessor):
    """By camera: how many frames with tracks there were, and the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "frame_idx long, frame_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.at.get() if self.at.exists() else (None, 0)
        frames = _in_order(rows, "frame_idx").drop_duplicates("frame_idx")
        if last is not None:
            frames = frames[frames["frame_idx"] > last]
        if len(frames):
            frames = frames.assign(camera_id=key[0], frame_seq=np.arange(n + 1, n + 1 + len(frames)))
            self.at.update((int(frames["frame_idx"].iloc[-1]), n + len(frames)))
            yield frames[["camera_id", "frame_idx", "ts", "frame_seq"]]

    def close(self) -> None:
        pass


def number_frames(tracks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """camera_id, frame_idx, ts and frame_seq of each frame that has tracks: what a run of presence is counted in.

    tracks: a stream of camera_id, frame_idx, ts; frames of a camera must come in order but for those of one batch. A
    camera's state is two numbers, and its rows here are narrow ones, one a frame."""
    frames = tracks.select("camera_id", "frame_idx", "ts").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["camera_id", "frame_idx"])
    return frames.groupBy("camera_id").transformWithStateInPandas(_Numbers(), "camera_id long, frame_idx long, ts timestamp, frame_seq long", "Append", "None", eventTimeColumnName="ts")


CONFIRMED = "camera_id long, tracker_id long, frame_idx long, ts timestamp, method string, n_embeddings long, mean_embedding array<double>, latest_face array<double>"


class _Confirm(StatefulProcessor):
    """By track: its run of presence, the qualifying embeddings in it, its latest face. Ends by a timer."""

    def __init__(self, wait_for: int, lifetime_ms: int):
        self.wait_for, self.lifetime = wait_for, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "frame_seq long, done boolean, until_ms long")
        self.bodies = handle.getListState("bodies", "body array<double>")
        self.face = handle.getValueState("face", "face array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, done, until = self.run.get() if self.run.exists() else (None, False, None)
        bodies = [x[0] for x in self.bodies.get()]
        face = self.face.get()[0] if self.face.exists() else None
        kept, out = len(bodies), []
        for r in _in_order(rows, "frame_seq").itertuples():
            if last is not None and r.frame_seq <= last:
                continue
            if last is not None and r.frame_seq > last + 1:  # it was absent, so what was kept is dropped
                done, bodies, face, kept = False, [], None, -1
            last = r.frame_seq
            until = _ms(r.ts) + self.lifetime
            if done:
                continue
            if r.qualifies:
                bodies.append(r.body)
                face = r.face if r.face is not None else face
            elif r.has_face:
                done = True
                out.append((*key, r.frame_idx, r.ts, "face", len(bodies), None, r.face if r.face is not None else face))
            if len(bodies) >= self.wait_for and not done:
                done = True
                mean = np.mean(np.array([list(b) for b in bodies], float), axis=0)
                out.append((*key, r.frame_idx, r.ts, "body", len(bodies), (mean / max(np.sqrt(mean @ mean), 1e-12)).tolist(), face))
            if done:
                bodies, face, kept = [], None, -1
        self.run.update((int(last), bool(done), int(until)))
        if kept != len(bodies):
            self.bodies.put([(np.asarray(b, float).tolist(),) for b in bodies]) if bodies else self.bodies.clear()
        self.face.update((np.asarray(face, float).tolist(),)) if face is not None else self.face.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(until))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONFIRMED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.run, self.bodies, self.face):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def confirm_tracks(tracks: DataFrame, params: Params = DEFAULTS, delay: str = "0 seconds", lifetime_seconds: int = 3600) -> DataFrame:
    """Rows of CONFIRMED: a track when a run of its presence has enough qualifying rows, with the unit mean of their
    bodies, or (method "face") when a row that doesn't qualify but has a face ends the wait before.

    tracks: a stream of camera_id, tracker_id, frame_idx, ts, frame_seq (as :func:`number_frames` gives it), qualifies,
    has_face, body and face. A run goes on where frame_seq does. Rows of a track must come in order but for those of one
    batch; older ones are left out. Nothing is kept by camera, and a track's rows go ``lifetime_seconds`` after its last."""
    rows = tracks.select("camera_id", "tracker_id", "frame_idx", "ts", "frame_seq", "qualifies", "has_face", "body", "face").withWatermark("ts", delay)
    return rows.groupBy("camera_id", "tracker_id").transformWithStateInPandas(_Confirm(params.pending_confirm_frames, 1000 * lifetime_seconds), CONFIRMED, "Append", "EventTime")


class _AsOf(StatefulProcessor):
    """By camera: the last settled frame that has tracks, the frames that aren't settled, and requests that wait.

    There is one timer, of the earliest request that waits: whatever the watermark has passed is answered at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "ts_ms long, frame_idx long")
        self.waiting = handle.getListState("waiting", "ts_ms long, frame_idx long, request_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        ms = [_ms(t) for t in new["ts"]]
        every = list(zip(ms, new["frame_idx"].tolist(), new["request_id"].tolist(), new["request_id"].notna().tolist(), strict=True))
        asked = [(t, int(f), r) for t, f, r, is_request in every if is_request]
        if asked:
            self.waiting.appendList(asked)
            self._wake(min(t for t, _, _ in asked))
        # frames behind the watermark can't be asked for but for the last of them: requests that old are dropped
        frames = {(t, int(f)) for t, f, _, is_request in every if not is_request}
        if frames:
            self._keep(frames | set(self.frames.get()), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def _wake(self, at: int) -> None:
        held = list(self.handle.listTimers())
        if not held or at < min(held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _keep(self, frames: set, settled: int) -> None:
        last = max((x for x in frames if x[0] <= settled), key=lambda x: x[1], default=None)
        self.frames.put(sorted(x for x in frames if x[0] > settled or x == last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        frames, waiting = set(self.frames.get()), list(self.waiting.get())
        done, rest = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(w[0] for w in rest))  # the one that fires is still listed
        else:
            self.waiting.clear()
        if frames:
            self._keep(frames, now)
        if done:
            taken = np.sort(np.array([f for _, f in frames], np.int64))
            at = np.searchsorted(taken, [f for _, f, _ in done], side="right")
            active = [int(taken[k - 1]) if k else None for k in at.tolist()]
            yield pd.DataFrame({"camera_id": key[0], "request_id": [w[2] for w in done], "active_frame": pd.array(active, "Int64")})

    def close(self) -> None:
        pass


def active_as_of_stream(requests: DataFrame, tracks: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """camera_id, request_id, active_frame: as :func:`identity_spark.operators.lookup.active_as_of`, continuously.

    requests: camera_id, request_id, frame_idx, ts; tracks: camera_id, frame_idx, ts. A request waits until the watermark
    has passed it, so frames that come after it but were taken before count. Later frames never change an answer."""
    frames = tracks.select("camera_id", "frame_idx", "ts", F.lit(None).cast("string").alias("request_id")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["camera_id", "frame_idx"])
    both = frames.unionByName(requests.select("camera_id", "frame_idx", "ts", "request_id").withWatermark("ts", delay))
    return both.groupBy("camera_id").transformWithStateInPandas(_AsOf(), "camera_id long, request_id string, active_frame long", "Append", "EventTime")


ENDED = "camera_id long, tracker_id long, global_id long, first_frame long, last_frame long, n_rows long"


class _Ends(StatefulProcessor):
    """By track: who it is and where it was first and last seen, until it hasn't been seen for a while."""

    def __init__(self, lifetime_ms: int):
        self.lifetime = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", "global_id long, first_frame long, last_frame long, last_ms long, n_rows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.track.get() if self.track.exists() else None, []
        for r in _in_order(rows, "ts").itertuples():
            ms = _ms(r.ts)
            if held is not None and ms - held[3] > self.lifetime:
                out.append((*key, held[0], held[1], held[2], held[4]))
                held = None
            gid, first, last, at, n = held or (None, r.frame_idx, r.frame_idx, ms, 0)
            held = (gid if pd.isna(r.global_id) else int(r.global_id), min(first, r.frame_idx), max(last, r.frame_idx), max(at, ms), n + 1)
        self.track.update(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(held[3] + self.lifetime)
        if out:
            yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in ENDED.split(", ")]).astype({"global_id": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.track.exists():
            gid, first, last, _, n = self.track.get()
            self.track.clear()
            yield self._frame([(*key, gid, first, last, n)])

    def close(self) -> None:
        pass


def track_ends(identified: DataFrame, delay: str = "10 seconds", lifetime_seconds: int = 30) -> DataFrame:
    """Rows of ENDED: a track once it hasn't been seen for ``lifetime_seconds``, with its last identity; it is then forgotten.

    identified: a stream of camera_id, tracker_id, frame_idx, ts, global_id. A track that comes again begins anew."""
    rows = identified.select("camera_id", "tracker_id", "frame_idx", "ts", "global_id").withWatermark("ts", delay)
    return rows.groupBy("camera_id", "tracker_id").transformWithStateInPandas(_Ends(1000 * lifetime_seconds), ENDED, "Append", "EventTime")


class _Identities(StatefulProcessor):
    """By identity: when and where it was last seen. Never forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last_frame long, n_tracks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get() if self.seen.exists() else (-1, 0)
        ended = pd.concat(list(rows), ignore_index=True)
        last, n = max(last, int(ended["last_frame"].max())), n + len(ended)
        self.seen.update((last, n))
        yield pd.DataFrame([(*key, last, n)], columns=["camera_id", "global_id", "last_frame", "n_tracks"])

    def close(self) -> None:
        pass


def identities_seen(ended: DataFrame) -> DataFrame:
    """camera_id, global_id, last_frame and n_tracks, a row whenever tracks of an identity have ended (mode "update").

    ended: a stream of rows of ENDED, as a table or a topic that :func:`track_ends` writes to."""
    known = ended.filter("global_id IS NOT NULL")
    return known.groupBy("camera_id", "global_id").transformWithStateInPandas(_Identities(), "camera_id long, global_id long, last_frame long, n_tracks long", "Update", "None")


def kept_state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """The rows of one state variable of a stream, as its last batch left them: key, value and partition.

    For an audit of what is kept, or of what one key holds; list states have a row an entry."""
    rows = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    return rows.load(checkpoint)
