"""Identities in a stream of observations, with a camera's galleries and tracks as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identify import RESULT, frame_step
from ..operators.identity import Camera
from ..params import DEFAULTS, Params

COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def identify_stream(observations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """As :func:`identity_spark.operators.identify.identify`, continuously; rows of a batch are taken in the order of frames.

    A frame's rows must come in one batch, as they do when they come from one message."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        camera = pickle.loads(state.get[0]) if state.exists else Camera(params)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["frame_idx", "det_seq"])
        out = [x for _, frame in rows.groupby("frame_idx", sort=True) for x in frame_step(camera, frame.to_dict("records"))]
        state.update((pickle.dumps(camera),))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["camera_id", *COLUMNS]) if out else pd.DataFrame(columns=["camera_id", *COLUMNS])

    return observations.groupBy("camera_id").applyInPandasWithState(run, f"camera_id long, {RESULT}", "camera binary", "append", GroupStateTimeout.NoTimeout)


def dedupe_late(rows: DataFrame, delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Rows of a stream without repeats of (camera, frame, track), and without those later than ``delay``."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["camera_id", "frame_idx", "tracker_id"])


def metrics_stream(rows: DataFrame, width: str = "10 seconds", delay: str | None = "10 seconds", ts: str = "ts", timings: list[str] | None = None) -> DataFrame:
    """Detections and identified tracks of each camera in tumbling windows; no delay where rows have a watermark already.

    timings: columns of milliseconds by stage, of which mean_<column> is given."""
    late = rows if delay is None else rows.withWatermark(ts, delay)
    windows = late.groupBy(F.window(ts, width), "camera_id")
    return windows.agg(F.count(F.lit(1)).alias("n_detections"), F.count("global_id").alias("n_identified"), *[F.avg(c).alias(f"mean_{c}") for c in timings or []])


def active_tracks(identified: DataFrame) -> DataFrame:
    """camera_id, frame_idx and tracks of each camera's latest frame that has any: what lookups take as active.

    identified: camera_id, frame_idx and tracks, an array of a frame's tracks; one row a frame, an empty array or null
    for a frame without tracks, which leaves the snapshot as it was. In a stream (output mode "update" or "complete")
    a camera's state is one frame."""
    some = identified.filter(F.size(F.coalesce("tracks", F.array())) > 0)
    return some.groupBy("camera_id").agg(F.max_by(F.struct("frame_idx", "tracks"), "frame_idx").alias("_last")).select("camera_id", "_last.*")
