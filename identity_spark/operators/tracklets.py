"""Tracks over time: movement, stability, runs of presence, confirmation, and linking of detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.vectors import l2_normalize, mean_vector
from ..params import DEFAULTS, Params

TRACK = ("camera_id", "tracker_id")


def by_frame():
    """Window of a track's rows in the order of frames."""
    return Window.partitionBy(*TRACK).orderBy("frame_idx")


def prev_bbox_iou(tracks: DataFrame) -> DataFrame:
    """Adds prev_iou: overlap with the same track's box before, null for its first one."""
    before = F.lag(boxes.box()).over(Window.partitionBy(*TRACK).orderBy("frame_idx"))
    out = tracks.withColumns({"_before": before})
    return out.withColumn("prev_iou", F.when(F.col("_before").isNotNull(), boxes.iou(boxes.box(), F.col("_before")))).drop("_before")


def stable_count(tracks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds stable_count: rows in a row whose overlap with the box before reaches the threshold.

    tracks: prev_iou and known_before (the track had an identity before this frame); rows that weren't count 0."""
    order = Window.partitionBy(*TRACK).orderBy("frame_idx")
    still = F.coalesce(F.col("known_before") & (F.col("prev_iou") >= params.stable_iou_threshold), F.lit(False))
    island = F.sum(F.when(still, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = tracks.withColumns({"_still": still, "_island": island})
    return out.withColumn("stable_count", F.sum(F.col("_still").cast("long")).over(Window.partitionBy(*TRACK, "_island").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))).drop("_still", "_island")


def pending_runs(tracks: DataFrame) -> DataFrame:
    """Adds frame_seq (of the camera's frames that have rows) and run: frames in a row that the track is in.

    Frames are numbered over the distinct frames, so the window by camera has a row for a frame, not for a track. Rows
    that have a frame_seq already, as a stored layout does, keep it, and meet nothing but their own track's."""
    if "frame_seq" in tracks.columns:
        return tracks.withColumn("run", F.col("frame_seq") - F.row_number().over(by_frame()))
    frames = tracks.select("camera_id", "frame_idx").distinct().withColumn("frame_seq", F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_idx")))
    seen = tracks.join(frames, ["camera_id", "frame_idx"])
    return seen.withColumn("run", F.col("frame_seq") - F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame_idx")))


def confirm_points(runs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds seen (qualifying rows of the run so far), face_ends_wait and confirms, which is true on one row of a run at most.

    runs: run, qualifies, and has_face. A row that doesn't qualify but has a face ends the wait: the track is then
    identified by its face alone."""
    so_far = Window.partitionBy(*TRACK, "run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = runs.withColumns({
        "seen": F.sum(F.col("qualifies").cast("long")).over(so_far),
        "_face": F.max((~F.col("qualifies") & F.col("has_face")).cast("int")).over(so_far),
    })
    out = out.withColumn("_full", (F.col("seen") >= params.pending_confirm_frames).cast("int"))
    done_before = F.coalesce(F.max(F.greatest("_face", "_full")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    out = out.withColumns({
        "face_ends_wait": (F.col("_face") == 1) & (F.col("_full") == 0) & ~done_before,
        "confirms": (F.col("_full") == 1) & (F.col("_face") == 0) & ~done_before,
    })
    return out.drop("_face", "_full")


def latest_face(runs: DataFrame, face: str) -> DataFrame:
    """Adds latest_face: the last face of the run on a qualifying row, up to the row."""
    so_far = Window.partitionBy(*TRACK, "run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("latest_face", F.last(F.when(F.col("qualifies"), F.col(face)), ignorenulls=True).over(so_far))


def mean_embeddings(confirmed: DataFrame, embedding: str, params: Params = DEFAULTS) -> DataFrame:
    """Unit mean of the embeddings that a confirmed run waited for: one row per (camera, track, run).

    confirmed: rows of :func:`confirm_points` with the embedding."""
    ends = confirmed.filter("confirms").select(*TRACK, "run", F.col("frame_idx").alias("confirm_frame"))
    rows = confirmed.filter("qualifies").join(ends, [*TRACK, "run"]).filter(F.col("frame_idx") <= F.col("confirm_frame"))
    return rows.groupBy(*TRACK, "run", "confirm_frame").agg(mean_vector(F.col(embedding)).alias("_mean"), F.count(F.lit(1)).alias("n_embeddings")).withColumn("mean_embedding", l2_normalize(F.col("_mean"))).drop("_mean")


def keyframe_gap(rows: DataFrame) -> DataFrame:
    """Adds keyframe_gap: frames since the identity's last key frame before the row (is_keyframe marks them)."""
    before = Window.partitionBy("camera_id", "global_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_keyframe"), F.col("frame_idx")), ignorenulls=True).over(before)
    return rows.withColumn("keyframe_gap", F.col("frame_idx") - last)


def drop_stale_pending(pending: DataFrame, frame_tracks: DataFrame) -> DataFrame:
    """Buffers whose track is in its camera's latest frame."""
    return pending.join(frame_tracks.select(*TRACK).distinct(), list(TRACK), "left_semi")


class Linker:
    """Track numbers of one camera's detections, frame by frame, by overlap in two stages.

    Detections of high confidence are linked to live and lost tracks from the best overlap down, then the others to
    tracks that the frame before had; what is left of the high ones starts tracks."""

    def __init__(self, high: float = 0.5, first: float = 0.2, second: float = 0.5, lost: int = 30):
        self.high, self.first, self.second, self.lost = high, first, second, lost
        self.box = np.zeros((0, 4))
        self.number = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.next, self.before = 1, -1

    def step(self, frame: int, b: np.ndarray, confidence: np.ndarray) -> np.ndarray:
        """Track of each detection, 0 for none."""
        live = frame - self.seen <= self.lost
        self.box, self.number, self.seen = self.box[live], self.number[live], self.seen[live]
        out = np.zeros(len(b), np.int64)
        at = np.full(len(b), -1)
        free = np.ones(len(self.number), bool)
        for rows, tracks, least in ((confidence >= self.high, np.ones(len(self.number), bool), self.first), (confidence < self.high, self.seen == self.before, self.second)):
            r, t = np.flatnonzero(rows), np.flatnonzero(tracks & free)
            o = _ious(b[r], self.box[t])
            for k in np.lexsort((np.tile(t, len(r)), np.repeat(r, len(t)), -o.ravel())).tolist() if o.size else []:
                i, j = r[k // len(t)], t[k % len(t)]
                if o.ravel()[k] < least:
                    break
                if at[i] < 0 and free[j]:
                    at[i], free[j] = j, False
        linked = at >= 0
        self.box[at[linked]], self.seen[at[linked]] = b[linked], frame
        out[linked] = self.number[at[linked]]
        new = np.flatnonzero(~linked & (confidence >= self.high))
        out[new] = self.next + np.arange(len(new))
        self.next += len(new)
        self.box, self.number, self.seen = np.concatenate([self.box, b[new]]), np.concatenate([self.number, out[new]]), np.concatenate([self.seen, np.full(len(new), frame)])
        self.before = frame
        return out


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.maximum(0, np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]))
    h = np.maximum(0, np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]))
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    both = w * h
    return np.where(both > 0, both / np.maximum(size(a)[:, None] + size(b)[None, :] - both, 1e-12), 0.0)


def link_tracks(detections: DataFrame, seq: str) -> DataFrame:
    """Adds tracker_id (null where there is none) to detections of (camera_id, frame_idx, x1..y2, confidence).

    A camera's frames follow one another, so cameras are the unit of parallel work; a camera's rows stream through its
    task in order and only live tracks are held."""
    names = detections.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in detections.schema)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linkers: tuple | None = None
        rest: pd.DataFrame | None = None

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal linkers
            b, c = rows[list(boxes.EDGES)].to_numpy(float), rows["confidence"].to_numpy(float)
            camera, frame = rows["camera_id"].to_numpy(), rows["frame_idx"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (camera[1:] != camera[:-1]) | (frame[1:] != frame[:-1])])
            numbers = np.zeros(len(rows), np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                if linkers is None or linkers[0] != camera[s]:
                    linkers = (camera[s], Linker())
                numbers[s:e] = linkers[1].step(int(frame[s]), b[s:e], c[s:e])
            return rows[names].assign(tracker_id=pd.Series(numbers, index=rows.index, dtype="Int64").mask(numbers == 0))

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = ((rows["camera_id"] == rows["camera_id"].iloc[-1]) & (rows["frame_idx"] == rows["frame_idx"].iloc[-1])).to_numpy()
            cut = int(np.argmax(last))
            rest = rows.iloc[cut:].reset_index(drop=True)
            if cut:
                yield run(rows.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest):
            yield run(rest)

    dealt = detections.repartition("camera_id").sortWithinPartitions("camera_id", "frame_idx", seq)
    return dealt.mapInPandas(walk, f"{fields}, tracker_id long")
