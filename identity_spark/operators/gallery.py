"""Galleries of key frames: what may enter, summaries, and the folds that keep them small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.vectors import dot, vector_sum
from ..params import DEFAULTS, UPPER_BODY, Params
from ..shared import checkpointed, small
from .identity import BodyGallery, Entry, FaceGallery, capped
from .match import own_sims
from .walk import Rows, folded

GID = ["camera_id", "global_id"]


def gallery_summary(gallery: DataFrame) -> DataFrame:
    """Entries, last key frame, best quality and whether any entry has a face, of each identity."""
    return gallery.groupBy(*GID).agg(F.count(F.lit(1)).alias("n_entries"), F.max("frame_idx").alias("last_keyframe"), F.max("pose_quality").alias("best_quality"), F.bool_or("has_face").alias("has_face"))


def gid_state(observations: DataFrame) -> DataFrame:
    """Frame an identity was last seen in, and its last box that isn't null; observations: x1..y2 and det_seq."""
    order = F.struct("frame_idx", "det_seq")
    box = F.when(F.col("x1").isNotNull(), boxes.box())
    last = F.max_by(box, F.when(F.col("x1").isNotNull(), order))
    return observations.groupBy(*GID).agg(F.max("frame_idx").alias("last_seen"), last.alias("_b")).select(*GID, "last_seen", "_b.*")


def has_entries(identities: DataFrame, faces: DataFrame) -> DataFrame:
    """Identities that have a face."""
    return identities.join(faces.select(*GID).distinct(), GID, "left_semi")


def needs_keyframe(candidates: DataFrame, summary: DataFrame, state: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds needs_keyframe to candidates of (camera_id, global_id, pose_quality, crop_empty); state is that before the frame."""
    out = candidates.join(summary.select(*GID, "n_entries", "last_keyframe", "best_quality"), GID, "left").join(state.select(*GID, F.col("last_seen").alias("_seen")), GID, "left")
    gap = F.coalesce("_seen", "last_keyframe") - F.col("last_keyframe") >= params.keyframe_min_interval
    due = F.col("n_entries").isNull() | gap | (F.col("pose_quality") > F.col("best_quality"))
    able = (F.coalesce("pose_quality", F.lit(0)) >= UPPER_BODY) & ~F.coalesce("crop_empty", F.lit(False))
    return out.withColumn("needs_keyframe", able & due).select(*candidates.columns, "needs_keyframe")


def needs_embedding(observations: DataFrame) -> DataFrame:
    """Rows to send to the body model: qualifying ones of tracks without identity or that need a key frame."""
    return observations.filter(F.col("qualifies") & (F.col("global_id").isNull() | F.col("needs_keyframe")))


def novel_view(candidates: DataFrame, gallery: DataFrame, key: str, params: Params = DEFAULTS, rates: DataFrame | None = None, crop: str | None = None) -> DataFrame:
    """Adds max_sim (or max_rate) and added: whether the candidate would enter its identity's gallery as it is.

    rates: match rates of (crop, entry_seq), which then decide in place of the cosines. crop: the candidates' column that
    they go by, the key if None; candidates of one crop and identity have one rate, so no candidate is paired with entries."""
    best = gallery.groupBy(*GID).agg(F.max("pose_quality").alias("_best"))
    if rates is None:
        by, name, least = [key, *GID], "max_sim", params.emb_novelty_threshold
        known = own_sims(candidates.select(*by, "embedding"), gallery, key).withColumnRenamed("score", name)
    else:
        by, name, least = [crop or key, *GID], "max_rate", params.match_rate_threshold
        asked = rates.select(by[0], "entry_seq", "match_rate").join(candidates.select(*by).distinct(), by[0])
        known = asked.join(gallery.select(*GID, "entry_seq"), [*GID, "entry_seq"]).groupBy(*by).agg(F.max("match_rate").alias(name))
    able = (F.coalesce("pose_quality", F.lit(0)) >= UPPER_BODY) & F.col("embedding").isNotNull()
    # what is asked of a vector is asked before the joins, so that it needn't go through them
    out = candidates.withColumn("_able", able).join(known, by, "left").join(best, GID, "left")
    fresh = F.col("_best").isNull() | (F.col(name) < least) | (F.col("pose_quality") > F.col("_best"))
    return out.withColumn("added", F.coalesce(F.col("_able") & fresh, F.lit(False))).select(*candidates.columns, name, "added")


def match_rate(matches: DataFrame, crops: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Matches of each pair of crops over the key points of a crop; 1.0 if either crop is empty. crops: crop_a, crop_b, empty."""
    counts = matches.groupBy("crop_a", "crop_b").agg(F.count(F.lit(1)).alias("_n"))
    rate = F.when(F.col("empty"), 1.0).otherwise(F.coalesce("_n", F.lit(0)) / F.lit(params.keypoints_per_crop))
    return crops.join(counts, ["crop_a", "crop_b"], "left").select("crop_a", "crop_b", rate.alias("match_rate"))


def max_match_rate(rates: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """key, camera_id, global_id and max_rate: the highest rate of a candidate with the entries of an identity.

    rates: key, entry_seq, match_rate (see :func:`match_rate`); entries: camera_id, global_id, entry_seq."""
    return rates.join(entries.select(*GID, "entry_seq"), "entry_seq").groupBy(key, *GID).agg(F.max("match_rate").alias("max_rate"))


def _alike(gallery: DataFrame) -> DataFrame:
    """Adds centrality and _n, the entries of the identity: a mean of dot products is one with the identity's sum."""
    sums = gallery.groupBy(*GID).agg(vector_sum(F.col("embedding")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    alike = gallery.join(small(checkpointed(sums), 20_000), GID)
    return alike.withColumn("centrality", (dot(F.col("embedding"), F.col("_sum")) - 1.0) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_sum")


def centrality(gallery: DataFrame) -> DataFrame:
    """Adds centrality: mean dot product of an entry, of length 1, with the others of its identity."""
    return _alike(gallery).drop("_n")


def evict_most_central(gallery: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One eviction: of identities above the cap the most central entry goes, the first of equal ones."""
    full = _alike(gallery).filter(F.col("_n") > params.max_gallery_per_gid)
    gone = full.groupBy(*GID).agg(F.max_by("entry_seq", F.struct(F.round("centrality", 12), -F.col("entry_seq"))).alias("entry_seq"))
    return gallery.join(gone, [*GID, "entry_seq"], "left_anti")


def update_body_gallery(candidates: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Final body gallery after all candidates of each identity in the order of frames.

    candidates: camera_id, global_id, frame_idx, obs_id, pose_quality, has_face, embedding. The fold needs its order, so
    identities are the unit of parallel work; one streams through with a gallery of bounded size as its state."""

    def step(g: BodyGallery, rows: Rows, ends: bool) -> list[tuple]:
        for v, *x in zip(rows.vectors("embedding"), *map(rows.values, ("frame_idx", "pose_quality", "has_face", "obs_id")), strict=True):
            if v is not None:
                g.offer(0, Entry(v.copy(), x[0], x[1], bool(x[2]), x[3]), None)
        return entries_of(g) if ends else []

    return folded(candidates, GID, ["frame_idx", "obs_id"], lambda: BodyGallery(params), step, BODY)


#: Columns of the entries that a fold gives.
BODY = "entry_seq long, frame_idx long, pose_quality int, has_face boolean, embedding array<double>"


def entries_of(g: BodyGallery) -> list[tuple]:
    return [(e.seq, e.frame, e.quality, e.has_face, e.vector.tolist()) for e in g.entries.get(0, [])]


def extended_bodies(gallery: DataFrame, rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The body gallery after the rows of a recording, in the order of frames, on top of what it held.

    gallery: camera_id, global_id, entry_seq, frame_idx, pose_quality, has_face, embedding. rows: the same columns, for every
    row in which an identity was seen, with det_seq and is_first, which marks a track's decision; a null embedding only
    moves last_seen. Other rows than first ones are offered where a key frame is due (P12), and then have to be new to the
    identity's view (P14). An identity that isn't in rows keeps its entries; others stream through, by identity."""
    columns = ["entry_seq", "frame_idx", "pose_quality", "has_face", "embedding"]
    held = gallery.select(*GID, *columns, F.lit(0).cast("long").alias("det_seq"), F.lit(False).alias("is_first"), F.lit(0).alias("_part"))
    seen = rows.select(*GID, *columns, F.col("det_seq").cast("long").alias("det_seq"), "is_first", F.lit(1).alias("_part"))
    touched = rows.select(*GID).distinct()
    every = held.join(touched, GID, "left_semi").unionByName(seen)
    every = every.withColumn("_at", F.when(F.col("_part") == 0, F.col("entry_seq")).otherwise(F.col("frame_idx")))

    def step(g: BodyGallery, rows: Rows, ends: bool) -> list[tuple]:
        for v, is_new, is_first, *x in zip(rows.vectors("embedding"), *map(rows.values, ("_part", "is_first", "frame_idx", "pose_quality", "has_face", "entry_seq")), strict=True):
            entry = None if v is None else Entry(v.copy(), x[0], x[1], bool(x[2]), x[3])
            if not is_new:
                g.entries.setdefault(0, []).append(entry)
            elif entry is not None and (is_first or g.needs_keyframe(0, entry.quality)):
                g.offer(0, entry, None)
            else:
                g.touch(0, x[0], None)
        return entries_of(g) if ends else []

    new = folded(every, GID, ["_part", "_at", "det_seq", "entry_seq"], lambda: BodyGallery(params), step, BODY)
    return gallery.select(*GID, *columns).join(touched, GID, "left_anti").unionByName(new.select(*GID, *columns))


def extended_faces(gallery: DataFrame, rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """As :func:`extended_bodies` for faces: camera_id, global_id, entry_seq, frame_idx, embedding, and det_seq in rows."""
    columns = ["entry_seq", "frame_idx", "embedding"]
    faces = rows.filter("embedding IS NOT NULL")
    touched = faces.select(*GID).distinct()
    held = gallery.select(*GID, *columns, F.lit(0).cast("long").alias("det_seq"), F.lit(0).alias("_part"), F.col("entry_seq").alias("_at"))
    every = held.join(touched, GID, "left_semi").unionByName(faces.select(*GID, *columns, F.col("det_seq").cast("long").alias("det_seq"), F.lit(1).alias("_part"), F.col("frame_idx").alias("_at")))

    def step(state: list, rows: Rows, ends: bool) -> list[tuple]:
        g, about = state
        for v, is_new, seq, frame in zip(rows.vectors("embedding"), *map(rows.values, ("_part", "entry_seq", "frame_idx")), strict=True):
            v = v.copy()
            about[id(v)] = (v, seq, frame)  # the vector is held, so nothing else has its id
            if is_new:
                g.offer(0, v)
            else:
                g.entries.setdefault(0, []).append(v)
            if len(about) > 2 * len(g.entries.get(0, [])) + 64:
                own = {id(x) for x in g.entries.get(0, [])}
                for k in [k for k in about if k not in own]:
                    del about[k]
        return [(about[id(v)][1], about[id(v)][2], v.tolist()) for v in g.entries.get(0, [])] if ends else []

    new = folded(every, GID, ["_part", "_at", "det_seq", "entry_seq"], lambda: [FaceGallery(params), {}], step, "entry_seq long, frame_idx long, embedding array<double>")
    return gallery.select(*GID, *columns).join(touched, GID, "left_anti").unionByName(new.select(*GID, *columns))


def update_face_gallery(faces: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """added and face_sim of each face (camera_id, global_id, frame_idx, face_seq, embedding), in the order of frames."""

    def step(g: FaceGallery, rows: Rows, ends: bool) -> list[tuple]:
        return [(f, n, *((False, None) if v is None else g.offer(0, v.copy()))) for v, f, n in zip(rows.vectors("embedding"), rows.values("frame_idx"), rows.values("face_seq"), strict=True)]

    return folded(faces, GID, ["frame_idx", "face_seq"], lambda: FaceGallery(params), step, "frame_idx long, face_seq long, added boolean, face_sim double")


def merge_entries(gallery: DataFrame, remap: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Gallery after identities went over into others: moved entries follow the target's own, then the cap holds.

    gallery: camera_id, global_id, entry_seq, embedding; remap: camera_id, source, target. An identity that isn't
    in remap and isn't a target stays as it is. Galleries are capped, so a target has the cap's entries from each of
    its sources; these are held while it is capped again, which takes a product with each entry that goes."""
    moved = gallery.join(remap.select("camera_id", F.col("source").alias("global_id"), "target"), GID, "left")
    touched = remap.select("camera_id", F.col("target").alias("_t")).distinct()
    rows = moved.withColumns({"_from": F.col("target").isNotNull().cast("int"), "global_id": F.coalesce("target", "global_id")}).drop("target")
    rows = rows.join(touched.withColumnRenamed("_t", "global_id").withColumn("_touched", F.lit(True)), GID, "left")
    kept = [c for c in gallery.columns if c not in GID]

    def step(state: list, rows: Rows, ends: bool) -> list[tuple]:
        state += zip((v.copy() for v in rows.vectors("embedding")), zip(*map(rows.values, kept), strict=True), strict=True)
        return [state[i][1] for i in capped([v for v, _ in state], params.max_gallery_per_gid)] if ends else []

    types = dict(gallery.dtypes)
    fold = folded(rows.filter("_touched"), GID, ["_from", "entry_seq"], list, step, ", ".join(f"{c} {types[c]}" for c in kept))
    return rows.filter("_touched IS NULL").select(*gallery.columns).unionByName(fold.select(*gallery.columns))

