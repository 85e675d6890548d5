"""Requests of a stream, each batch answered against the tables as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..operators.lookup import find_reference
from ..params import DEFAULTS, Params
from ..sources import messages, sinks

Tables = Callable[[], dict[str, DataFrame]]


def lookup_stream(requests: DataFrame, tables: Tables, path: str, params: Params = DEFAULTS) -> DataStreamWriter:
    """A writer that appends the answers of each batch to ``path``; a batch that is tried again overwrites its own folder.

    tables: gives gallery, faces, active, confirmed and pending as of now."""

    def answer(batch: DataFrame, number: int) -> None:
        t = tables()
        found = find_reference(batch, t["gallery"], t["faces"], t["active"], t["confirmed"], t["pending"], params)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer)


def lookup_messages(raw: DataFrame, embed: Callable[[DataFrame], DataFrame], tables: Tables, path: str, params: Params = DEFAULTS, camera: int | None = 0, bad: str | None = None) -> DataStreamWriter:
    """Request messages to result messages, as lines of text files in ``path``: read, embed, look up, write.

    raw: a stream with value; embed: gives body and face (either may be null) to rows of (request_id, image, and camera_id
    where that is asked for), as :mod:`identity_spark.operators.infer` does with a user's models. Requests are asked of one
    camera's galleries, or (camera None) of those of raw's camera_id, a batch's cameras together. bad: a folder for the
    text of messages that are no requests, in the same batches, so a message that is tried again is there once."""
    keep = ["camera_id"] if camera is None else []

    def answer(batch: DataFrame, number: int) -> None:
        t = tables()
        rows = embed(messages.read_find_requests(batch, keep=keep))
        asked_of = F.col("camera_id") if camera is None else F.lit(camera).cast("long").alias("camera_id")
        found = find_reference(rows.select(asked_of, "request_id", "body", "face"), t["gallery"], t["faces"], t["active"], t["confirmed"], t["pending"], params)
        if bad is not None:
            _, broken = messages.split_bad_json(batch, schemas.FIND_REQUEST)
            broken.select("value").write.mode("overwrite").text(f"{bad}/batch={number}")
        sinks.find_result_messages(found).select("value").write.mode("overwrite").text(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(answer)


def track_messages(raw: DataFrame, path: str, bad: str, keep: list[str] | None = None) -> DataStreamWriter:
    """Track messages of a stream as rows in the folder ``path``, by batch, and the text of those that are none in ``bad``."""

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            _, broken = messages.split_bad_json(batch, schemas.TRACK_MESSAGE)
            broken.select("value").write.mode("overwrite").text(f"{bad}/batch={number}")
            messages.read_track_messages(batch, keep=keep).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(split)
