"""Where is this person: requests against galleries and the tracks that are active."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..params import DEFAULTS, Params
from ..shared import checkpointed
from .match import match_with_face, own_sims


def active_as_of(requests: DataFrame, tracks: DataFrame, bucket: int = 10_000) -> DataFrame:
    """camera_id, request_id, active_frame: the latest frame with tracks at or before the request's frame.

    Requests and frames of a camera meet in buckets of so many frames; a bucket without a frame before the request takes
    the last one of the buckets before it, found over a row for each bucket."""
    place = F.floor(F.col("frame_idx") / bucket).alias("_bucket")
    frames = tracks.select("camera_id", "frame_idx").distinct().select("camera_id", place, "frame_idx", F.lit(None).cast("string").alias("request_id"), F.col("frame_idx").alias("_f"))
    asked = requests.select("camera_id", place, "frame_idx", "request_id", F.lit(None).cast("long").alias("_f"))
    order = Window.partitionBy("camera_id", "_bucket").orderBy("frame_idx", F.col("request_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = frames.unionByName(asked)
    last = both.groupBy("camera_id", "_bucket").agg(F.max("_f").alias("_last"))
    before = Window.partitionBy("camera_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("camera_id", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    here = both.withColumn("_here", F.last("_f", ignorenulls=True).over(order)).filter("request_id IS NOT NULL")
    return here.join(last, ["camera_id", "_bucket"]).select("camera_id", "request_id", F.coalesce("_here", "_before").alias("active_frame"))


def find_reference(requests: DataFrame, gallery: DataFrame, faces: DataFrame, active: DataFrame, confirmed: DataFrame, pending: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """camera_id, request_id, global_id, track_id, score, method of each request.

    requests: camera_id, request_id, body, face. active: camera_id, request_id, tracker_id, global_id, det_seq.
    confirmed: camera_id, request_id, tracker_id, global_id of tracks with an identity. pending: camera_id, request_id,
    tracker_id, embedding (the mean of the buffer). A hit takes the last active track that holds it."""
    asked = requests.withColumnRenamed("request_id", "query_id").withColumn("face", F.when(F.col("body").isNotNull(), F.col("face")))
    hits = checkpointed(match_with_face(asked.filter(F.col("body").isNotNull()), gallery, faces, params).withColumnRenamed("query_id", "request_id"))
    held = active.groupBy("camera_id", "request_id", "global_id").agg(F.max_by("tracker_id", "det_seq").alias("track_id"))
    hit = hits.join(held, ["camera_id", "request_id", "global_id"], "left")
    hit = hit.select("camera_id", "request_id", "global_id", F.coalesce("track_id", F.lit(-1).cast("long")).alias("track_id"), "score", F.when(F.col("track_id").isNull(), "gid_only").otherwise("track_gid").alias("method"))

    key = ["camera_id", "request_id"]
    missed = checkpointed(requests.select(*key, "body", "face").join(hits.select(*key), key, "left_anti"))
    known = missed.join(confirmed.select(*key, "tracker_id", "global_id"), key)
    # tracks of one identity have one score
    asked_of = checkpointed(known.select(*key, "global_id", "body", "face").dropDuplicates([*key, "global_id"]))
    best_of = lambda side, part, name: known.select(*key, "tracker_id", "global_id").join(own_sims(asked_of, side, "request_id", part), [*key, "global_id"]).groupBy(*key, "tracker_id").agg(F.max("score").alias(name))
    by_body = best_of(gallery, "body", "_body")
    by_face = best_of(faces, "face", "_face")
    own = by_body.join(by_face, [*key, "tracker_id"], "left").withColumn("score", F.when(F.col("_face").isNull(), F.col("_body")).otherwise((F.col("_body") + F.col("_face")) / 2))
    waiting = missed.join(pending.select(*key, "tracker_id", "embedding"), key).select(*key, "tracker_id", cosine(F.col("body"), F.col("embedding")).alias("score"))
    direct = own.select(*key, "tracker_id", "score", F.lit(0).alias("_kind")).unionByName(waiting.withColumn("_kind", F.lit(1)))
    best = direct.groupBy(*key).agg(F.max_by(F.struct("tracker_id", "score"), F.struct("score", -F.col("_kind"), -F.col("tracker_id"))).alias("_b"))
    there = active.select(*key).union(pending.select(*key)).distinct().withColumn("_there", F.lit(True))
    rest = missed.join(best, key, "left").join(there, key, "left")
    tried = F.col("body").isNotNull() & F.col("_there").isNotNull()
    rest = rest.select(*key, F.lit(-1).cast("long").alias("global_id"), F.when(tried, F.coalesce("_b.tracker_id", F.lit(-1).cast("long"))).otherwise(-1).cast("long").alias("track_id"), F.when(tried, F.coalesce("_b.score", F.lit(-1.0))).otherwise(0.0).alias("score"), F.when(tried, "direct").otherwise("none").alias("method"))
    return hit.unionByName(rest)


def flag_matched_track(tracks: DataFrame, result: DataFrame) -> DataFrame:
    """Adds matched, and the result's global_id, score and method to rows of the track that the latest result names."""
    found = result.filter("track_id <> -1").select("camera_id", F.col("track_id").alias("tracker_id"), F.col("global_id").alias("found_gid"), F.col("score").alias("found_score"), F.col("method").alias("found_method"))
    out = tracks.join(found, ["camera_id", "tracker_id"], "left")
    return out.withColumn("matched", F.col("found_method").isNotNull())


def correlate_lookup(requests: DataFrame, responses: DataFrame, arrival: str = "arrived") -> DataFrame:
    """Requests with the response that arrived last; nulls where none did."""
    names = [c for c in responses.columns if c not in ("request_id", arrival)]
    last = responses.groupBy("request_id").agg(F.max_by(F.struct(*names), arrival).alias("_r"))
    return requests.join(last, "request_id", "left").select(*requests.columns, "_r.*")
