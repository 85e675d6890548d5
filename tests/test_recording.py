"""A recording from tracks to galleries, against a plain walk over its frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from identity_spark.jobs import batch
from identity_spark.operators.identity import unit
from identity_spark.params import Params

PEOPLE = {"old": [1, 0, 0, 0, 0, 0], "other": [0, 1, 0, 0, 0, 0], "new": [0, 0, 1, 0, 0, 0], "alone": [0, 0, 0, 1, 0, 0]}


def seen(tid, who, frames, *, quality=2, face=None, bad=(), turn=0.0):
    out = []
    for f in frames:
        body = np.array(PEOPLE[who], float) + 0.01 * np.sin(f + np.arange(6)) + turn * (f > 60) * np.array([0, 0, 0, 0, 1, 0])
        ok = f not in bad
        out.append((0, f, tid, tid, ok, face is not None, body.tolist() if ok else None, face, quality if ok else 0, 0.0, 0.0, 10.0 + f, 20.0))
    return out


SCHEMA = "camera_id long, frame_idx long, det_seq long, tracker_id long, qualifies boolean, has_face boolean, body array<double>, face array<double>, pose_quality int, x1 double, y1 double, x2 double, y2 double"
PARAMS = Params(sim_threshold=0.8, pending_confirm_frames=3, keyframe_min_interval=20, max_gallery_per_gid=3, gid_merge_threshold=0.9)


@pytest.fixture(scope="module")
def tables(spark):
    rows = seen(1, "old", range(0, 100), turn=1.0) + seen(2, "new", range(0, 30)) + seen(3, "new", range(40, 90), face=[0.0, 1.0])
    # one whose first row doesn't qualify but has a face that the gallery knows, and one that is never there for long
    rows += seen(4, "other", range(5, 15), face=[1.0, 0.02], bad=range(5, 9)) + seen(5, "alone", [20, 21]) + seen(6, "alone", range(50, 60), quality=1)
    bodies = [(0, 7, 3, -500, 2, False, PEOPLE["old"]), (0, 8, 4, -400, 1, True, PEOPLE["other"]), (0, 2, 5, -300, 1, True, [0, 0, 0, 0, 0, 1])]
    faces = [(0, 8, 1, -400, [1.0, 0.0])]
    as_doubles = [(*b[:-1], [float(x) for x in b[-1]]) for b in bodies]
    return (
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(as_doubles, "camera_id long, global_id long, entry_seq long, frame_idx long, pose_quality int, has_face boolean, embedding array<double>"),
        spark.createDataFrame(faces, "camera_id long, global_id long, entry_seq long, frame_idx long, embedding array<double>"),
    )


def plain_entries(rows, held, first, params):
    """Key frames of one identity: (frame, vector) in order; rows: (frame, vector, quality) from its decision on."""
    own, last_seen = list(held), None
    for f, v, q in rows:
        due = f == first or not own or (last_seen is not None and last_seen - max(e[0] for e in own) >= params.keyframe_min_interval) or q > max(e[2] for e in own)
        last_seen = f
        if not due:
            continue
        if own and max(float(unit(np.array(e[1])) @ unit(v)) for e in own) >= params.emb_novelty_threshold and q <= max(e[2] for e in own):
            continue
        own.append((f, v, q))
        if len(own) > params.max_gallery_per_gid:
            m = np.stack([unit(np.array(e[1])) for e in own])
            own.pop(int(np.argmax((m @ m.T).sum(axis=1))))
    return own


def test_recording(spark, tables):
    observations, bodies, faces = tables
    done = batch.identify_recording(observations, bodies, faces, None, PARAMS)
    tracks = {r["tracker_id"]: r for r in done.tracks.collect()}
    assert set(tracks) == {1, 2, 3, 4, 6}
    assert (tracks[1]["global_id"], tracks[1]["match_type"], tracks[1]["frame_idx"]) == (7, "B", 2)
    # the known face decides at once, although the body would have come later
    assert (tracks[4]["global_id"], tracks[4]["match_type"], tracks[4]["frame_idx"]) == (8, "F", 5)
    # two tracks of one new person were new twice, and are one identity now
    assert tracks[2]["global_id"] == tracks[3]["global_id"] == 9 and tracks[2]["is_new"]
    assert (tracks[3]["match_type"], tracks[3]["match_score"], tracks[3]["is_new"]) == ("MERGE", 0.9, False)
    assert tracks[6]["match_type"] == "NEW" and tracks[6]["global_id"] == 11
    assert [(r["source"], r["target"]) for r in done.remap.collect()] == [(10, 9)]

    entries = {}
    for r in sorted(done.bodies.collect(), key=lambda r: r["entry_seq"]):
        entries.setdefault(r["global_id"], []).append((r["frame_idx"], r["embedding"]))
    assert entries[2] == [(-300, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]  # wasn't seen
    own = [r for r in observations.filter("tracker_id = 1 AND frame_idx >= 2").orderBy("frame_idx").collect()]
    mean = unit(np.mean([r["body"] for r in observations.filter("tracker_id = 1 AND frame_idx <= 2").collect()], axis=0))
    want = plain_entries([(r["frame_idx"], mean if r["frame_idx"] == 2 else np.array(r["body"]), 2) for r in own], [(-500, [float(x) for x in PEOPLE["old"]], 2)], 2, PARAMS)
    assert [f for f, _ in entries[7]] == [f for f, _, _ in want] and len(want) > 1
    for (_, a), (_, b, _) in zip(entries[7], want, strict=True):
        assert a == pytest.approx(list(b))
    assert len(entries[9]) <= PARAMS.max_gallery_per_gid and {f for f, _ in entries[9]} <= {2, 42}
    assert 10 not in entries and len(entries[11]) == 1
    assert {r["global_id"] for r in done.faces.collect()} == {8, 9}
    state = {r["global_id"]: r["last_seen"] for r in done.state.collect()}
    assert state == {7: 99, 8: 14, 9: 89, 11: 59}


def test_the_next_recording_knows_them(spark, tables):
    observations, bodies, faces = tables
    first = batch.identify_recording(observations, bodies, faces, None, PARAMS)
    later = observations.filter("tracker_id IN (2, 6)").withColumn("tracker_id", F.col("tracker_id") + 100).withColumn("frame_idx", F.col("frame_idx") + 1000)
    second = batch.identify_recording(later, first.bodies, first.faces, first.state, PARAMS)
    assert {r["tracker_id"]: (r["global_id"], r["match_type"]) for r in second.tracks.collect()} == {102: (9, "B"), 106: (11, "B")}
    assert {r["global_id"]: r["last_seen"] for r in second.state.collect()} == {7: 99, 8: 14, 9: 1029, 11: 1059}
    assert second.remap.count() == 0


def test_an_empty_recording(spark, tables):
    observations, bodies, faces = tables
    done = batch.identify_recording(observations.limit(0), bodies, faces, None, PARAMS)
    assert done.tracks.count() == 0 and done.bodies.count() == 3 and done.faces.count() == 1 and done.state.count() == 0


def test_galleries_far_above_the_cap_take_a_product_an_entry(monkeypatch):
    """Entries that came in above the cap: the same ones go as by pairs of all, and no square of them is made."""
    from identity_spark.operators import identity
    from identity_spark.operators.identity import BodyGallery, Entry, FaceGallery, most_central

    rng = np.random.default_rng(8)
    held, new = [unit(x) for x in rng.normal(size=(300, 12))], [unit(x) for x in rng.normal(size=(400, 12))]
    left = list(held)
    for v in new:
        left.pop(most_central(left))
        left.append(v)
    bodies = [*held, new[0]]
    while len(bodies) > 10:
        bodies.pop(most_central(bodies))

    def squared(vectors):
        assert len(vectors) <= 64
        return most_central(vectors)

    monkeypatch.setattr(identity, "most_central", squared)
    faces = FaceGallery(Params(face_keyframe_threshold=1.1), {0: list(held)})
    alike = [faces.offer(0, v)[1] for v in new]
    assert [id(v) for v in faces.entries[0]] == [id(v) for v in left]
    assert alike[0] == pytest.approx(max(float(new[0] @ v) for v in held))
    g = BodyGallery(Params(emb_novelty_threshold=1.1), {0: [Entry(v, i, 2, False, i) for i, v in enumerate(held)]})
    assert not BodyGallery(Params(), {0: list(g.entries[0])}).offer(0, Entry(held[3], 500, 2, False), None)
    assert g.offer(0, Entry(new[0], 400, 2, False, 400), None)
    assert [id(e.vector) for e in g.entries[0]] == [id(v) for v in bodies]
