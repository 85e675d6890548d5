"""One-to-one assignment of completed tracks, numbers for new identities, and enrichment of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .walk import Rows, folded

FRAME = ["camera_id", "frame_idx"]


def rank_completions(completions: DataFrame) -> DataFrame:
    """Adds place: order of a frame's completions by prescore (null counts 0.0), then by det_seq.

    Those by face alone (by_face, where there is such a column) go before all others, by det_seq."""
    rank = F.coalesce("prescore", F.lit(0.0))
    first = [F.desc("by_face"), F.when(~F.col("by_face"), -rank)] if "by_face" in completions.columns else [F.desc(rank)]
    order = Window.partitionBy(*FRAME).orderBy(*first, "det_seq")
    return completions.withColumn("place", F.row_number().over(order))


def greedy_assign(scores: DataFrame, completions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """camera_id, frame_idx, tracker_id, global_id and match_score of each completion; both null for a new identity.

    scores: camera_id, frame_idx, tracker_id, global_id, score, first_seq of eligible identities. In the order of place
    each takes its best identity that none took before in the frame. A frame has few rows; frames stream through."""
    ranked = rank_completions(completions).select(*FRAME, "tracker_id", "place")
    best = scores.filter(F.col("score") >= params.sim_threshold)
    rows = ranked.join(best, [*FRAME, "tracker_id"], "left")

    def step(state: tuple[dict, set], rows: Rows, ends: bool) -> list[tuple]:
        own, taken = state
        for t, g, score in zip(rows.values("tracker_id"), rows.values("global_id"), rows.values("score"), strict=True):
            own.setdefault(t, (None, None))
            if g is not None and own[t][0] is None and g not in taken:
                taken.add(g)
                own[t] = (g, score)
        return [(t, *x) for t, x in own.items()] if ends else []

    return folded(rows.withColumn("_down", -F.col("score")), FRAME, ["place", "_down", "first_seq"], lambda: ({}, set()), step, "tracker_id long, global_id long, match_score double")


def new_gid_numbers(assigned: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Gives rows without global_id the next numbers of their camera, by (frame_idx, place). highest: camera_id, highest.

    Frames are counted first and numbered over their counts, so the window by camera has a row a frame."""
    new = assigned.filter("global_id IS NULL")
    counts = new.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("camera_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.withColumn("_before", before).drop("_n")
    if highest is not None:
        start = start.join(highest, "camera_id", "left").withColumn("_before", F.col("_before") + F.coalesce(F.col("highest") + 1, F.lit(0))).drop("highest")
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("place"))
    numbered = new.withColumn("_k", place).join(start, FRAME).withColumn("global_id", (F.col("_before") + F.col("_k") - 1).cast("long"))
    return assigned.filter("global_id IS NOT NULL").withColumn("is_new", F.lit(False)).unionByName(numbered.select(*assigned.columns, F.lit(True).alias("is_new")))


def known_gid(observations: DataFrame, track_map: DataFrame) -> DataFrame:
    """Adds the identity of tracks that have one."""
    return observations.join(track_map.select("camera_id", "tracker_id", "global_id"), ["camera_id", "tracker_id"], "left")


def enrich_tracks(tracks: DataFrame, identities: DataFrame) -> DataFrame:
    """Every track with its identity and match: -1, 0.0 and "B" where there is none. identities: a row a track."""
    out = tracks.join(identities.select("camera_id", "tracker_id", "global_id", "match_score", "match_type"), ["camera_id", "tracker_id"], "left")
    return out.withColumns({"global_id": F.coalesce("global_id", F.lit(-1).cast("long")), "match_score": F.coalesce("match_score", F.lit(0.0)), "match_type": F.coalesce("match_type", F.lit("B"))})
