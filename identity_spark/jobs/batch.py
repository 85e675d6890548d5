"""Whole jobs over tables: who the tracks of a recording are, and one gallery from near-duplicate identities."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.vectors import l2_normalize, mean_vector
from ..operators import assign, gallery, match, merge, pose, tracklets
from ..params import DEFAULTS, Params
from ..shared import checkpointed, small

TRACK = ["camera_id", "tracker_id"]
FRAME = ["camera_id", "frame_idx"]


def frames_for_pose(observations: DataFrame, known: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Observations with cached_quality and stable_count, and needs_pose of their frame: where it is false, the pose model
    isn't asked and the cached qualities of the frame's tracks count.

    observations: camera_id, frame_idx, tracker_id, x1..y2, pose_quality (null where it wasn't made). known: camera_id,
    tracker_id, global_id and since, the frame from which the track is known."""
    rows = observations.join(known.select(*TRACK, "global_id", "since"), TRACK, "left").withColumn("known_before", F.coalesce(F.col("frame_idx") > F.col("since"), F.lit(False)))
    rows = tracklets.stable_count(tracklets.prev_bbox_iou(rows), params)
    # what was known before the frame decides, so the frame's own quality doesn't count
    before = F.lag("cached_quality").over(tracklets.by_frame())
    rows = pose.last_known_quality(rows).withColumn("cached_quality", before).withColumn("known", F.col("known_before"))
    return rows.join(pose.frame_needs_pose(rows, params), FRAME).drop("known", "known_before")


def identify_tracks(observations: DataFrame, bodies: DataFrame, faces: DataFrame, known: DataFrame | None = None, params: Params = DEFAULTS, by_face: bool = False) -> DataFrame:
    """A row for each track that is decided: camera_id, tracker_id, frame_idx, global_id, match_score, match_type, is_new.

    observations: camera_id, frame_idx, det_seq, tracker_id, qualifies, has_face, body, face and x1..y2. A track is
    decided on the frame that completes its first run of qualifying rows, by the mean of their bodies and its latest
    face; on that frame identities of known tracks are out, and of the others each goes to one track. What is left
    gets new numbers after the highest of the gallery. known: camera_id, tracker_id, global_id of tracks that have one.
    by_face: a row that doesn't qualify but has a face decides its track at once, by the face alone (type "F"), and before
    the frame's other tracks."""
    rows = observations if known is None else observations.join(known.select(*TRACK), TRACK, "left_anti")
    return _identified(observations, decisions(rows, params, by_face), bodies, faces, known, params, by_face)


def decisions(rows: DataFrame, params: Params = DEFAULTS, by_face: bool = False) -> DataFrame:
    """A row for each track that is decided: camera_id, tracker_id, run, frame_idx, det_seq, by_face, mean_embedding and
    latest_face, as :func:`identify_tracks` says.

    The windows by track have no vectors in them: they tell which rows a decision goes by, and only theirs are fetched."""
    names = [*TRACK, "frame_idx", "det_seq", "qualifies", "has_face", *(["frame_seq"] if "frame_seq" in rows.columns else [])]
    narrow = rows.select(*names, F.when(F.col("face").isNotNull(), F.col("frame_idx")).alias("_face_at"))
    runs = tracklets.latest_face(tracklets.confirm_points(tracklets.pending_runs(narrow), params), "_face_at").withColumnRenamed("latest_face", "_last_face")
    ends = runs.filter(F.col("confirms") | F.col("face_ends_wait")) if by_face else runs.filter("confirms")
    own = F.struct("run", "frame_idx", "det_seq", F.col("face_ends_wait").alias("by_face"), F.when(F.col("face_ends_wait"), F.coalesce("_face_at", "_last_face")).otherwise(F.col("_last_face")).alias("_last_face"))
    first = checkpointed(ends.groupBy(*TRACK).agg(F.min_by(own, "frame_idx").alias("_f")).select(*TRACK, "_f.*"))
    last = first.filter("NOT by_face").select(*TRACK, "run", F.col("frame_idx").alias("_end"))
    waits = checkpointed(runs.filter("qualifies").join(small(last), [*TRACK, "run"]).filter("frame_idx <= _end").select(*TRACK, "frame_idx"))
    means = rows.select(*TRACK, "frame_idx", "body").join(small(waits), [*TRACK, "frame_idx"]).groupBy(*TRACK).agg(mean_vector(F.col("body")).alias("_mean"))
    shown = first.filter("_last_face IS NOT NULL").select(*TRACK, F.col("_last_face").alias("frame_idx"))
    shown = rows.filter("face IS NOT NULL").select(*TRACK, "frame_idx", F.col("face").alias("latest_face")).join(small(shown), [*TRACK, "frame_idx"]).drop("frame_idx")
    done = first.drop("_last_face").join(means.select(*TRACK, l2_normalize(F.col("_mean")).alias("mean_embedding")), TRACK, "left").join(shown, TRACK, "left")
    return checkpointed(done)


def _identified(observations: DataFrame, done: DataFrame, bodies: DataFrame, faces: DataFrame, known: DataFrame | None, params: Params, by_face: bool) -> DataFrame:
    """Identities of the tracks of :func:`decisions`."""
    least = params.sim_threshold
    alone = match.all_top1_sims(done.filter("latest_face IS NULL AND NOT by_face"), bodies, query="tracker_id", vector="mean_embedding", least=least)
    with_face = match.fused_scores(done.filter("latest_face IS NOT NULL AND NOT by_face"), bodies, faces, params.face_match_strategy, least, query="tracker_id", body="mean_embedding", face="latest_face")
    columns = [*TRACK, "global_id", "score", "first_seq"]
    scores = alone.select(*columns).unionByName(with_face.withColumn("first_seq", F.col("global_id")).select(*columns)).filter(F.col("score") >= least)
    if by_face:
        only = match.fused_scores(done.filter("by_face"), bodies, faces, "face_only_top1", params.face_sim_threshold, query="tracker_id", body="mean_embedding", face="latest_face")
        only = only.filter(F.col("score") >= params.face_sim_threshold)
        scores = scores.unionByName(only.withColumn("first_seq", F.col("global_id")).select(*columns))
    if known is not None:
        held = observations.join(known.select(*TRACK, "global_id"), TRACK).select(*FRAME, "global_id").distinct()
        scores = match.exclude_active(scores, done.select(*TRACK, "frame_idx").join(held, FRAME), "tracker_id")
    scores = checkpointed(scores.join(done.select(*TRACK, "frame_idx"), TRACK))
    best = scores.groupBy(*TRACK).agg(F.max("score").alias("prescore"))
    completions = done.select(*FRAME, "tracker_id", "det_seq", "by_face").join(best, TRACK, "left")
    # scores are held against their own thresholds above
    assigned = assign.greedy_assign(scores, completions, replace(params, sim_threshold=-2.0)).join(assign.rank_completions(completions).select(*FRAME, "tracker_id", "place"), [*FRAME, "tracker_id"])
    highest = bodies.select("camera_id", "global_id").unionByName(faces.select("camera_id", "global_id")).groupBy("camera_id").agg(F.max("global_id").alias("highest"))
    named = assign.new_gid_numbers(assigned, highest).join(done.select(*TRACK, "latest_face", "by_face"), TRACK)
    kind = F.when(F.col("is_new"), "NEW").when(F.col("by_face"), "F").when(F.col("latest_face").isNotNull(), "F+B").otherwise("B")
    return named.select(*TRACK, "frame_idx", "global_id", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), kind.alias("match_type"), "is_new")


@dataclass
class Merged:
    """Tables after a merge, and remap (camera_id, source, target) with every target a root."""

    remap: DataFrame
    bodies: DataFrame
    faces: DataFrame
    track_map: DataFrame
    state: DataFrame


def merge_identities(bodies: DataFrame, faces: DataFrame, track_map: DataFrame, state: DataFrame, params: Params = DEFAULTS, only: DataFrame | None = None) -> Merged:
    """Near-duplicate identities go over into their oldest one: entries under the cap, tracks and states with them.

    bodies and faces: camera_id, global_id, entry_seq, embedding and more; track_map: camera_id, tracker_id, global_id;
    state: camera_id, global_id, last_seen, x1..y2. only: camera_id, global_id of those that may go, all if None. With a
    threshold of 1 none does."""
    edges = merge.merge_candidates(bodies, params)
    if only is not None:
        edges = edges.join(only.withColumnRenamed("global_id", "source"), ["camera_id", "source"], "left_semi")
    remap = checkpointed(merge.roots(edges.filter(F.lit(params.gid_merge_threshold < 1.0))))
    own_cap = Params(max_gallery_per_gid=params.max_face_gallery_per_gid)
    return Merged(remap, gallery.merge_entries(bodies, remap, params), gallery.merge_entries(faces, remap, own_cap), merge.remap_gids(track_map, remap), merge.merge_state(state, remap))


@dataclass
class Recording:
    """What a recording leaves: its tracks' identities, the galleries with what they gained, and the state of identities."""

    tracks: DataFrame
    bodies: DataFrame
    faces: DataFrame
    state: DataFrame
    remap: DataFrame


def identify_recording(observations: DataFrame, bodies: DataFrame, faces: DataFrame, state: DataFrame | None = None, params: Params = DEFAULTS) -> Recording:
    """A recording from its tracks to the galleries for the next one.

    Tracks are decided against the galleries as they stand (:func:`identify_tracks`, by face alone too); then each
    identity's gallery takes the mean of its tracks' waits, key frames of their later rows, and faces; then new identities
    that are near-duplicates go over into older ones, which so come to be one where two tracks of a new person were
    decided apart, and their tracks have the type MERGE with the threshold as score.

    observations: as for identify_tracks, with pose_quality; bodies and faces: entries with entry_seq, frame_idx and (bodies)
    pose_quality, has_face; state: camera_id, global_id, last_seen, x1..y2. Numbers of new entries follow the camera's
    highest one, in the order of frames."""
    done = decisions(observations, params, by_face=True)
    found = checkpointed(_identified(observations, done, bodies, faces, None, params, by_face=True))
    decided = checkpointed(found.select(*TRACK, "global_id", F.col("frame_idx").alias("since")).join(done.select(*TRACK, "mean_embedding", "latest_face"), TRACK))
    plain = decided.select(*TRACK, "global_id", "since")
    seen_from = lambda rows: rows.join(small(plain), TRACK).filter("frame_idx >= since")
    # numbers and states go by rows without vectors
    rows = seen_from(observations.select(*TRACK, "frame_idx", "det_seq", boxes.box().alias("_box")))
    counts = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("camera_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = rows.select(*FRAME, "tracker_id", "det_seq").withColumn("_k", F.row_number().over(Window.partitionBy(*FRAME).orderBy("det_seq")))
    dealt = checkpointed(dealt.join(counts.withColumn("_before", before).drop("_n"), FRAME).select(*FRAME, "tracker_id", "det_seq", (F.col("_before") + F.col("_k") - 1).alias("_place")))
    base = lambda g: g.groupBy("camera_id").agg((F.max("entry_seq") + 1).alias("_base"))
    first = decided.select(*TRACK, F.col("since").alias("frame_idx"), "mean_embedding", "latest_face")

    def numbered(rows: DataFrame, g: DataFrame) -> DataFrame:
        out = rows.join(dealt, [*FRAME, "tracker_id", "det_seq"]).join(F.broadcast(base(g)), "camera_id", "left")
        out = out.withColumn("entry_seq", F.coalesce("_base", F.lit(0)) + F.col("_place")).join(small(plain), TRACK)
        return out.withColumn("is_first", F.col("frame_idx") == F.col("since")).join(small(first), [*TRACK, "frame_idx"], "left")

    body = F.when(F.col("is_first"), F.col("mean_embedding")).when(F.col("qualifies"), F.col("body"))
    face = F.when(F.col("is_first"), F.col("latest_face")).otherwise(F.col("face"))
    offered = observations.select(*FRAME, "tracker_id", "det_seq", "qualifies", "has_face", F.col("pose_quality").cast("int").alias("pose_quality"), F.when(F.col("qualifies"), F.col("body")).alias("body"))
    new_bodies = gallery.extended_bodies(bodies, numbered(offered, bodies).withColumn("embedding", body), params)
    shown = seen_from(observations.select(*FRAME, "tracker_id", "det_seq", "face")).filter("face IS NOT NULL OR frame_idx = since").drop("global_id", "since")
    new_faces = gallery.extended_faces(faces, numbered(shown, faces).withColumn("embedding", face), params)

    seen = rows.groupBy("camera_id", "global_id").agg(F.max("frame_idx").alias("last_seen"), F.max_by("_box", F.struct("frame_idx", "det_seq")).alias("_b")).select("camera_id", "global_id", "last_seen", "_b.*")
    if state is not None:
        seen = state.join(seen.select("camera_id", "global_id"), ["camera_id", "global_id"], "left_anti").select(seen.columns).unionByName(seen)
    tracks = found.select(*TRACK, "global_id")
    merged = merge_identities(checkpointed(new_bodies), checkpointed(new_faces), tracks, seen, params, only=found.filter("is_new").select("camera_id", "global_id").distinct())
    gone = merged.remap.select("camera_id", F.col("source").alias("global_id"), "target")
    named = found.join(gone, ["camera_id", "global_id"], "left")
    near = F.col("target").isNotNull()
    named = named.select(*TRACK, "frame_idx", F.coalesce("target", "global_id").alias("global_id"), F.when(near, F.lit(params.gid_merge_threshold)).otherwise(F.col("match_score")).alias("match_score"), F.when(near, "MERGE").otherwise(F.col("match_type")).alias("match_type"), (F.col("is_new") & ~near).alias("is_new"))
    return Recording(named, merged.bodies, merged.faces, merged.state, merged.remap)
