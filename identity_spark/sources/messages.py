"""Track messages and lookup requests: JSON text to rows, good and bad ones apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def message_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """value (a message's text) of every line of the text files in ``path``, as a table or as a stream of new files.

    A topic is read by Spark's own source for it, whose rows have a value too."""
    return spark.readStream.schema("value STRING").text(path) if stream else spark.read.text(path)


def parsed(raw: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Adds the message's fields as ``m`` and is_bad: text that is no JSON of this schema. For batch and stream alike."""
    m = F.from_json(F.col(value).cast("string"), schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.withColumn("m", m).withColumn("is_bad", F.col("m").isNull() | F.col("m._corrupt").isNotNull())


def split_bad_json(raw: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a source; the bad ones keep their text for a dead-letter sink."""
    both = parsed(raw, schema, value)
    return both.filter(~F.col("is_bad")).drop("is_bad"), both.filter("is_bad").select(*raw.columns)


def read_track_messages(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row a tracked box, and one of nulls for a frame without tracks; ``keep`` names further columns of the source.

    The frame's payload isn't among the rows: :func:`frame_payloads` has it, so it rides through no shuffle of tracks.
    Messages without a stamp or a frame number count as bad."""
    good, _ = split_bad_json(raw, schemas.TRACK_MESSAGE, value)
    good = good.filter(F.col("m.stamp").isNotNull() & F.col("m.frame_idx").isNotNull())
    rows = good.select(*(keep or []), F.timestamp_seconds("m.stamp").alias("ts"), "m.stamp", "m.frame_idx", F.coalesce("m.frame_h", F.lit(1)).alias("frame_h"), F.coalesce("m.frame_w", F.lit(1)).alias("frame_w"), F.explode_outer("m.tracks").alias("t"))
    b = F.col("t.bbox")
    edges = [F.element_at(b, i + 1).alias(e) for i, e in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select(*(keep or []), "ts", "stamp", "frame_idx", "frame_h", "frame_w", "t.tracker_id", *edges, "t.confidence")


def frame_payloads(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """frame_idx, frame bytes (null where there are none), size (1 x 1 where it is missing) and has_frame."""
    good, _ = split_bad_json(raw, schemas.TRACK_MESSAGE, value)
    return good.select(*(keep or []), "m.frame_idx", decoded(F.col("m.frame_jpeg_b64")).alias("frame"), F.coalesce("m.frame_h", F.lit(1)).alias("frame_h"), F.coalesce("m.frame_w", F.lit(1)).alias("frame_w")).withColumn("has_frame", F.col("frame").isNotNull())


def read_find_requests(raw: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """request_id ("" where it is missing) and image bytes of the requests that have an image; ``keep`` names further columns."""
    good, _ = split_bad_json(raw, schemas.FIND_REQUEST, value)
    asked = good.filter(F.length(F.coalesce("m.image_jpeg_b64", F.lit(""))) > 0)
    return asked.select(*(keep or []), F.coalesce("m.request_id", F.lit("")).alias("request_id"), decoded(F.col("m.image_jpeg_b64")).alias("image"))


def decoded(text: Column) -> Column:
    """Bytes of base64 text; null for null, empty or broken text."""
    return F.when(F.length(text) > 0, F.try_to_binary(text, F.lit("base64")))


def encoded(data: Column) -> Column:
    """Base64 text of bytes; "" for null. Without line breaks, as JSON readers expect it."""
    return F.coalesce(F.regexp_replace(F.base64(data), r"\s", ""), F.lit(""))
