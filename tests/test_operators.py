"""Hand-computed cases of the identity operators, and folds against what they must keep."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from identity_spark.functions import boxes
from identity_spark.operators import assign, detect, faces, gallery, infer, lookup, match, merge, pose, tracklets
from identity_spark.operators.identity import BodyGallery, Camera, Entry, FaceGallery, Seen, most_central, unit
from identity_spark.params import FULL_BODY, NONE, UPPER_BODY, Params
from identity_spark.sources import messages, sinks

BOX = "camera_id long, frame_idx long, obs_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (0, 0, 5, 10), 0.5), ((0, 0, 1, 1), (5, 5, 6, 6), 0.0)])
def test_iou(spark, a, b, want):
    s = lambda v: F.struct(*[F.lit(float(x)).alias(e) for x, e in zip(v, boxes.EDGES, strict=True)])
    assert spark.range(1).select(boxes.iou(s(a), s(b))).first()[0] == pytest.approx(want)


def kps(**seen):
    points = {"nose": 0, "ls": 5, "rs": 6, "lh": 11, "rh": 12}
    c = {points[k]: v for k, v in seen.items()}
    return [(float(i), float(i), c.get(i, 0.0)) for i in range(17)]


@pytest.mark.parametrize(("points", "want"), [(kps(ls=0.9, rs=0.9, lh=0.9, rh=0.9), FULL_BODY), (kps(nose=0.9, ls=0.9, rs=0.9), UPPER_BODY), (kps(nose=0.9), NONE), (kps(ls=0.5, rs=0.5, nose=0.5), UPPER_BODY), (kps(ls=0.9, rs=0.9), NONE)])
def test_pose_quality(spark, points, want):
    row = spark.createDataFrame([(points,)], "kps array<struct<x:double,y:double,c:double>>")
    assert row.select(pose.quality(F.col("kps"), 0.5)).first()[0] == want


def test_poses_go_to_the_first_of_equal_overlaps(spark):
    d = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 10.0, 10.0), (0, 1, 2, 50.0, 0.0, 60.0, 10.0)], BOX)
    p = spark.createDataFrame([(0, 1, 8, 0.0, 0.0, 10.0, 3.0, 2), (0, 1, 7, 0.0, 7.0, 10.0, 10.0, 1)], "camera_id long, frame_idx long, pose_seq long, x1 double, y1 double, x2 double, y2 double, quality int")
    out = {r["obs_id"]: (r["pose_seq"], r["pose_quality"]) for r in pose.assign_poses(d, p, "obs_id").collect()}
    assert out == {1: (7, 1), 2: (None, 0)}  # both overlap by 0.30 exactly


def test_faces_on_the_edge_and_shared(spark):
    d = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 10.9, 10.0), (0, 1, 2, 10.0, 0.0, 30.0, 10.0)], BOX)
    f = spark.createDataFrame([(0, 1, 5, 8, 0, 4, 4), (0, 1, 4, 8, 0, 4, 4), (0, 1, 6, 9, 0, 4, 4)], "camera_id long, frame_idx long, face_seq long, x int, y int, w int, h int")
    out = {r["obs_id"]: r["face_seq"] for r in faces.assign_faces(d, f, "obs_id").collect()}
    assert out == {1: 4, 2: 4}


def test_suppression_keeps_no_overlap_above_the_limit():
    rng = np.random.default_rng(0)
    corner = rng.uniform(0, 50, (200, 2))
    b, score = np.hstack([corner, corner + rng.uniform(5, 30, (200, 2))]), rng.uniform(size=200)
    kept = detect.suppressed(b, score, np.arange(200), 0.3)
    o = tracklets._ious(b[kept], b[kept]) - np.eye(len(kept))
    assert o.max() <= 0.3
    lost = np.setdiff1d(np.arange(200), kept)
    assert all(any(tracklets._ious(b[[i]], b[[k]])[0, 0] > 0.3 and score[k] >= score[i] for k in kept) for i in lost)


def vec(*x):
    return unit(np.array(x, float))


def test_galleries_evict_in_their_own_order():
    rng = np.random.default_rng(1)
    body, face = BodyGallery(Params(max_gallery_per_gid=3)), FaceGallery(Params(max_face_gallery_per_gid=3))
    for i in range(20):
        v = unit(rng.normal(size=8))
        body.offer(0, Entry(v, i, UPPER_BODY, False, i), None)
        added, _ = face.offer(0, v)
        assert len(body.entries[0]) <= 3 and len(face.entries[0]) <= 3
        assert added and face.entries[0][-1] is v  # a new face always stays
    four = [vec(1, 0, 0), vec(0, 1, 0), vec(0, 0, 1), vec(1, 1, 1)]
    assert most_central(four) == 3


def test_face_similarity_at_the_threshold_is_not_added():
    g = FaceGallery(Params(face_keyframe_threshold=1.0))
    assert g.offer(0, vec(1, 0)) == (True, -1.0)
    assert g.offer(0, vec(1, 0)) == (False, 1.0)


def test_keyframes(spark):
    g = BodyGallery()
    g.offer(1, Entry(vec(1, 0), 0, UPPER_BODY, False), None)
    g.touch(1, 59, None)
    assert not g.needs_keyframe(1, UPPER_BODY) and g.needs_keyframe(1, FULL_BODY) and not g.needs_keyframe(2, NONE)
    g.touch(1, 60, None)
    assert g.needs_keyframe(1, UPPER_BODY) and g.needs_keyframe(2, UPPER_BODY)


def seen(tid, v, box=(0, 0, 10, 10), quality=FULL_BODY, face=None):
    return Seen(tid, np.array(box, float), quality, v, face)


def test_camera_confirms_after_five_frames_and_finds_again():
    c = Camera()
    for k in range(5):
        out = c.step([seen(1, vec(1, 0, 0)), seen(2, vec(0, 1, 0))])
        assert bool(out) == (k == 4)
    assert [(x[0], x[1], x[3]) for x in out] == [(1, 0, "NEW"), (2, 1, "NEW")]
    for _ in range(5):
        out = c.step([seen(9, vec(0, 1, 0.1))])
    assert out[0][1] == 1 and out[0][3] == "B" and out[0][2] == pytest.approx(float(vec(0, 1, 0.1) @ vec(0, 1, 0)))


def test_camera_drops_buffers_of_absent_tracks_but_not_on_empty_frames():
    c = Camera()
    for _ in range(4):
        c.step([seen(1, vec(1, 0))])
    c.step([])
    assert c.step([seen(1, vec(1, 0))])
    c = Camera()
    for _ in range(4):
        c.step([seen(1, vec(1, 0))])
    c.step([seen(2, vec(0, 1))])
    assert not c.step([seen(1, vec(1, 0))])


def test_camera_face_alone_and_merge():
    c = Camera()
    out = c.step([seen(1, None, face=vec(1, 0))])
    assert out[0][1:4] == (0, 0.0, "NEW")
    assert c.step([seen(2, None, face=vec(1, 0.1))])[0][3] == "F"
    c = Camera(Params(sim_threshold=0.999, gid_merge_threshold=0.9))
    for _ in range(5):
        c.step([seen(1, vec(1, 0))])
    for _ in range(5):
        out = c.step([seen(2, vec(1, 0.2))])
    assert out[0][1:4] == (0, 0.9, "MERGE") and list(c.body.entries) == [0]


def test_camera_gives_an_identity_once_a_frame():
    rng = np.random.default_rng(3)
    c = Camera(Params(sim_threshold=0.2))
    for f in range(120):
        tids = [t for t in range(6) if rng.uniform() < 0.9]
        out = c.step([seen(t + 10 * (f // 20), unit(rng.normal(size=4))) for t in tids])
        assert len({x[1] for x in out if x[3] != "MERGE"}) == len([x for x in out if x[3] != "MERGE"])
        assert all(len(e) <= 10 for e in c.body.entries.values())


def test_greedy_assignment_takes_the_next_best(spark):
    done = spark.createDataFrame([(0, 1, 1, 0, 0.95), (0, 1, 2, 1, 0.90), (0, 1, 3, 2, None)], "camera_id long, frame_idx long, tracker_id long, det_seq long, prescore double")
    scores = spark.createDataFrame([(0, 1, 1, 7, 0.95, 0), (0, 1, 2, 7, 0.90, 0), (0, 1, 2, 8, 0.85, 1), (0, 1, 3, 8, 0.99, 1), (0, 1, 3, 9, 0.5, 2)], "camera_id long, frame_idx long, tracker_id long, global_id long, score double, first_seq long")
    out = {r["tracker_id"]: r["global_id"] for r in assign.greedy_assign(scores, done).collect()}
    assert out == {1: 7, 2: 8, 3: None}


def test_runs_survive_empty_frames(spark):
    t = spark.createDataFrame([(0, f, 1) for f in (1, 2, 4)] + [(0, f, 2) for f in (1, 2, 4, 6)] + [(0, 7, 1)], "camera_id long, frame_idx long, tracker_id long")
    out = {(r["tracker_id"], r["frame_idx"]): r["run"] for r in tracklets.pending_runs(t).collect()}
    assert out[1, 1] == out[1, 4] and out[1, 4] != out[1, 7]


def test_matching_thresholds_and_exclusion(spark):
    g = spark.createDataFrame([(0, 1, 1, [1.0, 0.0], True), (0, 2, 2, [1.0, 0.0], False), (0, 3, 3, [0.8, 0.6], True)], "camera_id long, global_id long, entry_seq long, embedding array<double>, has_face boolean")
    q = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, None), (0, 3, [-1.0, 0.0])], "camera_id long, query_id long, embedding array<double>")
    assert [(r["query_id"], r["global_id"]) for r in match.match(q, g, Params(sim_threshold=1.0)).collect()] == [(1, 1)]
    active = spark.createDataFrame([(0, 1, 1)], "camera_id long, query_id long, global_id long")
    assert [r["global_id"] for r in match.match(q, g, Params(sim_threshold=1.0), active=active).collect()] == [2]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_block_size_changes_no_score(spark, monkeypatch, block):
    monkeypatch.setattr(match, "BLOCK", block)
    rng = np.random.default_rng(0)
    g = [(0, int(i % 5), i, rng.normal(size=4).tolist()) for i in range(30)]
    q = [(0, i, rng.normal(size=4).tolist()) for i in range(12)]
    out = {(r["query_id"], r["global_id"]): r["score"] for r in match.all_top1_sims(spark.createDataFrame(q, "camera_id long, query_id long, embedding array<double>"), spark.createDataFrame(g, "camera_id long, global_id long, entry_seq long, embedding array<double>")).collect()}
    for _, i, v in q:
        for gid in range(5):
            assert out[i, gid] == pytest.approx(max(float(unit(np.array(v)) @ unit(np.array(e))) for _, k, _, e in g if k == gid))


def test_roots_jump_over_chains(spark):
    edges = spark.createDataFrame([(0, i, i - 1) for i in range(1, 40)] + [(1, 5, 3)], "camera_id long, source long, target long")
    out = {(r["camera_id"], r["source"]): r["target"] for r in merge.roots(edges).collect()}
    assert out == {(0, i): 0 for i in range(1, 40)} | {(1, 5): 3}


def test_merged_entries_follow_and_are_capped(spark):
    rng = np.random.default_rng(2)
    rows = [(0, g, i, unit(rng.normal(size=4)).tolist()) for g in (0, 1, 2) for i in range(g * 10, g * 10 + 8)]
    g = spark.createDataFrame(rows, "camera_id long, global_id long, entry_seq long, embedding array<double>")
    out = gallery.merge_entries(g, spark.createDataFrame([(0, 1, 0)], "camera_id long, source long, target long")).collect()
    vectors, seqs = [np.array(r[3]) for r in rows if r[1] < 2], [r[2] for r in rows if r[1] < 2]
    while len(vectors) > 10:
        k = most_central(vectors)
        vectors.pop(k), seqs.pop(k)
    assert sorted(r["entry_seq"] for r in out if r["global_id"] == 0) == seqs and sum(r["global_id"] == 2 for r in out) == 8


def test_lookup_methods(spark):
    key = "camera_id long, request_id string"
    asked = spark.createDataFrame([(0, "held", [1.0, 0.0], None), (0, "lost", [0.0, 1.0], None), (0, "near", [0.7, -0.7], None), (0, "face", None, [1.0, 0.0]), (0, "void", [-1.0, 0.0], None)], f"{key}, body array<double>, face array<double>")
    g = spark.createDataFrame([(0, 1, 1, [1.0, 0.0], False), (0, 2, 2, [0.0, 1.0], False)], "camera_id long, global_id long, entry_seq long, embedding array<double>, has_face boolean")
    f = g.select("camera_id", "global_id", "entry_seq", "embedding").limit(0)
    active = spark.createDataFrame([(0, r, t, 1, t) for r in ("held", "near", "face") for t in (4, 5)], f"{key}, tracker_id long, global_id long, det_seq long")
    pending = spark.createDataFrame([(0, "near", 9, [0.7, -0.6])], f"{key}, tracker_id long, embedding array<double>")
    out = {r["request_id"]: (r["global_id"], r["track_id"], r["method"]) for r in lookup.find_reference(asked, g, f, active, active, pending).collect()}
    assert out == {"held": (1, 5, "track_gid"), "lost": (2, -1, "gid_only"), "near": (-1, 9, "direct"), "face": (-1, -1, "none"), "void": (-1, -1, "none")}


def test_bad_messages_are_kept_apart(spark):
    raw = spark.createDataFrame([('{"stamp": 1.5, "frame_idx": 3, "tracks": [{"tracker_id": 1, "bbox": [1, 2, 3, 4], "confidence": 0.5}]}',), ('{"stamp": 1.5, "frame_idx": 4, "tracks": []}',), ('{"stamp": 1.',), (None,)], "value string")
    rows = messages.read_track_messages(raw).collect()
    assert sorted((r["frame_idx"], r["tracker_id"], r["x2"], r["frame_h"]) for r in rows if r["tracker_id"]) == [(3, 1, 3, 1)] and len(rows) == 2
    good, bad = messages.split_bad_json(raw, "stamp DOUBLE")
    assert (good.count(), bad.count()) == (2, 2)


def test_crop_store_round_trip(spark, tmp_path):
    (tmp_path / "face").mkdir()
    (tmp_path / "gid0003_f0000012.jpg").write_bytes(b"a")
    (tmp_path / "face" / "gid0004_f0000013.jpg").write_bytes(b"b")
    out = sorted((r["global_id"], r["frame_idx"], r["kind"], bytes(r["crop"])) for r in sinks.read_gallery_crops(spark, str(tmp_path)).collect())
    assert out == [(3, 12, "body", b"a"), (4, 13, "face", b"b")]
    assert sorted(r["frame_idx"] for r in sinks.read_frames(spark, str(tmp_path)).select("frame_idx").collect()) == [12]


def test_models_run_in_batches(spark):
    crops = spark.createDataFrame([(i, None if i == 3 else bytes([i])) for i in range(10)], "i long, crop binary")
    make = {"two": lambda: lambda xs: [[float(x[0]) + 1, 0.0] for x in xs], "bad": lambda: lambda xs: 1 / 0}
    out = {r["i"]: r["embedding"] for r in infer.embed_table(crops, make, "two").collect()}
    assert out[3] is None and out[5] == [1.0, 0.0]
    assert all(r["embedding"] is None for r in infer.embed_table(crops, make, "bad").collect())
    with pytest.raises(ValueError, match="unknown strategy"):
        infer.embed_table(crops, make, "none")
    poses = infer.pose_table(crops.withColumnRenamed("crop", "frame"), {"p": lambda: lambda xs: [[{"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "score": 0.5, "kps": []}] * 2 for _ in xs]}, "p")
    assert poses.count() == 18


def test_linker_keeps_numbers():
    link = tracklets.Linker()
    a = np.array([[0, 0, 10, 10], [50, 0, 60, 10]], float)
    assert link.step(0, a, np.array([0.9, 0.9])).tolist() == [1, 2]
    assert link.step(1, a[::-1] + 1, np.array([0.9, 0.3])).tolist() == [2, 1]
    assert link.step(20, a[:1], np.array([0.9])).tolist() == [1]
    assert link.step(21, a, np.array([0.9, 0.3])).tolist() == [1, 0]  # track 2 wasn't in the frame before
    assert link.step(60, a, np.array([0.9, 0.9])).tolist() == [3, 4]


def test_blocks_are_full_with_many_cameras(spark):
    rows = spark.range(8000).select((F.col("id") % 200).alias("camera_id"), F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    packed, sizes = match._packed(rows, ["query_id"], "embedding", F.xxhash64("query_id", F.lit(1)))
    assert packed.count() == 200 and sizes.agg(F.max("parts")).first()[0] == 1
    one = spark.range(5000).select(F.lit(7).cast("long").alias("camera_id"), F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding"))
    sizes = [r["n"] for r in match._packed(one, ["query_id"], "embedding", F.xxhash64("query_id", F.lit(1)))[0].select(F.size("query_id").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 5000 and max(sizes) < 1300


def test_top1_sims_by_camera(spark):
    rng = np.random.default_rng(3)
    g = [(c, i % 4, 10 * c + i, rng.normal(size=5).tolist()) for c in range(30) for i in range(8)]
    q = [(c, 100 * c + i, rng.normal(size=5).tolist()) for c in range(31) for i in range(3)]
    found = match.all_top1_sims(spark.createDataFrame(q, "camera_id long, query_id long, embedding array<double>"), spark.createDataFrame(g, "camera_id long, global_id long, entry_seq long, embedding array<double>"))
    out = {(r["query_id"], r["global_id"]): r["score"] for r in found.collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(i, k): max(cos(v, w) for d, e, _, w in g if (d, e) == (c, k)) for c, i, v in q for k in range(4) if c < 30}
    assert out == pytest.approx(want)


def test_capped_is_as_one_by_one():
    rng = np.random.default_rng(4)
    for n in (1, 9, 10, 11, 60):
        vectors = [unit(x) for x in rng.normal(size=(n, 6))]
        left = list(range(n))
        while len(left) > 10:
            left.pop(most_central([vectors[i] for i in left]))
        assert gallery.capped(vectors, 10) == left


def test_active_as_of_over_buckets(spark):
    tracks = spark.createDataFrame([(0, 3), (0, 12), (0, 55), (1, 40)], "camera_id long, frame_idx long")
    asked = spark.createDataFrame([(0, 2, "a"), (0, 3, "b"), (0, 49, "c"), (0, 90, "d"), (1, 39, "e"), (2, 9, "f")], "camera_id long, frame_idx long, request_id string")
    out = {r["request_id"]: r["active_frame"] for r in lookup.active_as_of(asked, tracks, bucket=10).collect()}
    assert out == {"a": None, "b": 3, "c": 12, "d": 55, "e": None, "f": None}


def test_identify_tracks(spark):
    from identity_spark.jobs import batch

    rows = []
    for f in range(8):
        for k, t in enumerate((1, 2, 3)):
            v = [1.0, 0.0] if t < 3 else [0.0, 1.0]
            rows.append((0, f, 3 * f + k, t, True, False, v, None, 0.0, 0.0, 9.0, 9.0))
    seen = spark.createDataFrame(rows, "camera_id long, frame_idx long, det_seq long, tracker_id long, qualifies boolean, has_face boolean, body array<double>, face array<double>, x1 double, y1 double, x2 double, y2 double")
    bodies = spark.createDataFrame([(0, 4, 1, [1.0, 0.1], True)], "camera_id long, global_id long, entry_seq long, embedding array<double>, has_face boolean")
    faces_of = bodies.select("camera_id", "global_id", "entry_seq", "embedding").limit(0)
    out = {r["tracker_id"]: (r["frame_idx"], r["global_id"], r["match_type"]) for r in batch.identify_tracks(seen, bodies, faces_of).collect()}
    assert out == {1: (4, 4, "B"), 2: (4, 5, "NEW"), 3: (4, 6, "NEW")}  # one identity goes to one track
    known = spark.createDataFrame([(0, 3, 4)], "camera_id long, tracker_id long, global_id long")
    out = {r["tracker_id"]: (r["global_id"], r["match_type"]) for r in batch.identify_tracks(seen, bodies, faces_of, known).collect()}
    assert out == {1: (5, "NEW"), 2: (6, "NEW")}  # a known track of the frame holds it


def test_frames_for_pose(spark):
    from identity_spark.jobs import batch

    rows = [(0, f, f, 1, 0.0, 0.0, 10.0, 10.0, 2 if f == 0 else None) for f in range(5)]
    seen = spark.createDataFrame(rows, "camera_id long, frame_idx long, obs_id long, tracker_id long, x1 double, y1 double, x2 double, y2 double, pose_quality int")
    known = spark.createDataFrame([(0, 1, 7, 0)], "camera_id long, tracker_id long, global_id long, since long")
    out = {r["frame_idx"]: (r["needs_pose"], r["cached_quality"]) for r in batch.frames_for_pose(seen, known, Params(stable_min_frames=3)).collect()}
    assert out == {0: (True, None), 1: (True, 2), 2: (True, 2), 3: (False, 2), 4: (False, 2)}


def test_crops_and_messages_to_files(spark, tmp_path):
    crops = spark.createDataFrame([(0, 3, 7, bytearray(b"a")), (1, 4, 8, None)], "camera_id long, global_id long, frame_idx long, crop binary")
    sinks.write_crops(crops, "/crops", str(tmp_path / "crops"), face=True)
    back = {r["global_id"]: (r["camera_id"], r["crop_path"], r["crop"] and bytes(r["crop"])) for r in spark.read.parquet(str(tmp_path / "crops")).collect()}
    assert back == {3: (0, "/crops/face/gid0003_f0000007.jpg", b"a"), 4: (1, "", None)}
    found = spark.createDataFrame([("r1", 2, -1, 0.5, "gid_only")], "request_id string, global_id long, track_id long, score double, method string")
    sinks.write_messages(sinks.find_result_messages(found), str(tmp_path / "out"))
    text = messages.message_files(spark, str(tmp_path / "out"))
    assert [r["value"] for r in text.collect()] == ['{"request_id":"r1","global_id":2,"track_id":-1,"score":0.5,"method":"gid_only"}']


def test_active_tracks_of_a_stream(spark, tmp_path):
    from identity_spark.streaming.identify import active_tracks

    schema = "camera_id long, frame_idx long, tracks array<struct<tracker_id:long,global_id:long>>"
    for k, rows in enumerate([[(0, 1, [(1, 5)]), (0, 2, [(1, 5), (2, 6)])], [(0, 3, []), (1, 3, [(9, 0)]), (0, 4, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = active_tracks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(f"active{k}").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = {r["camera_id"]: (r["frame_idx"], [tuple(t) for t in r["tracks"]]) for r in spark.table(f"active{k}").collect()}
    assert out == {0: (2, [(1, 5), (2, 6)]), 1: (3, [(9, 0)])}


def test_lookup_messages(spark, tmp_path):
    from identity_spark.streaming.lookup import lookup_messages

    asked = ['{"request_id": "a", "image_jpeg_b64": "AQA="}', '{"request_id": "b", "image_jpeg_b64": "AAE="}', '{"request_id": "c"}', "{broken"]
    spark.createDataFrame([(x,) for x in asked], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    raw = messages.message_files(spark, str(tmp_path / "in"), stream=True)
    body = F.array(*[F.conv(F.substring(F.hex("image"), 2 * k + 1, 2), 16, 10).cast("double") for k in range(2)])
    embed = lambda rows: rows.select("request_id", body.alias("body"), F.lit(None).cast("array<double>").alias("face"))
    g = spark.createDataFrame([(0, 4, 1, [1.0, 0.0], True)], "camera_id long, global_id long, entry_seq long, embedding array<double>, has_face boolean")
    held = spark.createDataFrame([(0, "a", 8, 4, 1)], "camera_id long, request_id string, tracker_id long, global_id long, det_seq long")
    none = held.limit(0)
    tables = lambda: {"gallery": g, "faces": g.limit(0), "active": held, "confirmed": none, "pending": none.withColumn("embedding", F.array(F.lit(0.0)))}
    lookup_messages(raw, embed, tables, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "out"))
    assert {r["request_id"]: (r["global_id"], r["track_id"], r["method"]) for r in out.collect()} == {"a": (4, 8, "track_gid"), "b": (-1, -1, "none")}


def test_lookup_messages_of_many_cameras(spark, tmp_path):
    from identity_spark.streaming.lookup import lookup_messages

    asked = [(0, '{"request_id": "a", "image_jpeg_b64": "AQA="}'), (1, '{"request_id": "b", "image_jpeg_b64": "AQA="}'), (2, '{"request_id": "c", "image_jpeg_b64": "AQA="}'), (1, "{broken")]
    spark.createDataFrame(asked, "camera_id long, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("camera_id long, value string").parquet(str(tmp_path / "in"))
    embed = lambda rows: rows.select("camera_id", "request_id", F.array(F.lit(1.0), F.lit(0.0)).alias("body"), F.lit(None).cast("array<double>").alias("face"))
    g = spark.createDataFrame([(0, 4, 1, [1.0, 0.0], True), (1, 9, 1, [1.0, 0.1], True)], "camera_id long, global_id long, entry_seq long, embedding array<double>, has_face boolean")
    none = spark.createDataFrame([], "camera_id long, request_id string, tracker_id long, global_id long, det_seq long")
    tables = lambda: {"gallery": g, "faces": g.limit(0), "active": none, "confirmed": none, "pending": none.withColumn("embedding", F.array(F.lit(0.0)))}
    lookup_messages(raw, embed, tables, str(tmp_path / "out"), camera=None, bad=str(tmp_path / "bad")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "out"))
    assert {r["request_id"]: (r["global_id"], r["method"]) for r in out.collect()} == {"a": (4, "gid_only"), "b": (9, "gid_only"), "c": (-1, "none")}
    assert [r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "bad")).collect()] == ["{broken"]


def test_stage_metrics_with_timings(spark):
    from identity_spark.operators import report

    rows = spark.createDataFrame([(0, 1, 4, 2, 10.0), (0, 2, 6, 0, 30.0), (0, 31, 1, 1, 5.0)], "camera_id long, frame_idx long, n_detections long, n_embedded long, pose_ms double")
    out = {r["window"]: (r["n_frames"], r["mean_pose_ms"], r["max_pose_ms"]) for r in report.stage_metrics(rows, 30, ["pose_ms"]).collect()}
    assert out == {0: (2, 20.0, 30.0), 1: (1, 5.0, 5.0)}


def test_a_failing_input_costs_its_own_output():
    calls = []

    def model(xs):
        calls.append(len(xs))
        if 13 in xs:
            raise RuntimeError("13")
        return [x * 2 for x in xs]

    out = infer.attempted(model, list(range(64)))
    assert [x for x, _ in out] == [None if k == 13 else 2 * k for k in range(64)] and out[13][1] == "RuntimeError: 13"
    assert len(calls) == 13 and infer.attempted(lambda xs: [1], [5, 6]) == [(1, None), (1, None)]


def test_batches_of_a_model_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(k, b"x" * (100 if k % 5 else 1000)) for k in range(40)], "i int, crop binary").coalesce(1)
    sizes = lambda: lambda xs: [[float(sum(map(len, xs))), float(len(xs))] for _ in xs]
    out = infer.run_model(rows, {"s": sizes}, "s", "crop", "seen", "array<double>", batch=7, batch_bytes=900).collect()
    assert max(r["seen"][1] for r in out) <= 7
    assert all(r["seen"][0] <= 900 or r["seen"][1] == 1 for r in out)
