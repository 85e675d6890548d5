"""The registered queries of the identity operators, each with the SQL that gives the same rows, where SQL can.

Every query runs its operator over whole views of the given tables (see :mod:`fixtures`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import boxes
from ..functions.labels import quality_letter, quality_number, track_label
from ..functions.vectors import cosine, l2_normalize, mean_vector, sigmoid
from ..operators import assign, detect, faces, gallery, lookup, match, merge, pose, report, tracklets
from ..operators.identify import identify
from ..params import DEFAULTS, Params
from ..sources import messages, sinks
from ..streaming.identify import active_tracks, metrics_stream
from . import batch, folds
from .fixtures import Views, oracle, overlap_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CAM = ["camera_id", "frame_idx"]


def registered(sql: str | None = None):
    """Registers a function of the views under its own name."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def rounded(name: str, column=None, digits: int = 5):
    return F.round(F.col(name) if column is None else column, digits).alias(name)


def track_json(v: Views) -> DataFrame:
    """Track messages of the tracks view: every 50th is cut in half, every 20th has no tracks."""
    t = F.struct("tracker_id", F.array(*[F.col(e).cast("int") for e in boxes.EDGES]).alias("bbox"), "confidence")
    frames = v.tracks.groupBy(*CAM).agg(F.sort_array(F.collect_list(t)).alias("tracks"))
    empty = F.array().cast("array<struct<tracker_id:bigint,bbox:array<int>,confidence:double>>")
    body = F.struct((F.col("frame_idx") / 10).alias("stamp"), "frame_idx", F.lit(480).alias("frame_h"), F.lit(640).alias("frame_w"), F.base64(F.encode(F.col("frame_idx").cast("string"), "UTF-8")).alias("frame_jpeg_b64"), F.when(F.col("frame_idx") % 20 == 7, empty).otherwise(F.col("tracks")).alias("tracks"))
    text = frames.select("camera_id", F.col("frame_idx").alias("sent"), F.to_json(body).alias("value"))
    return text.withColumn("value", F.when(F.col("sent") % 50 == 3, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")))


@registered("""
    SELECT camera_id, frame_idx, CASE WHEN frame_idx % 20 <> 7 THEN tracker_id END AS tracker_id, CASE WHEN frame_idx % 20 <> 7 THEN CAST(x1 AS INT) END AS x1, CASE WHEN frame_idx % 20 <> 7 THEN CAST(y2 AS INT) END AS y2,
      CASE WHEN frame_idx % 20 <> 7 THEN round(confidence, 5) END AS confidence, 480 AS frame_h, frame_idx / 10 AS stamp
    FROM tracks WHERE frame_idx % 50 <> 3 AND frame_idx % 20 <> 7
    UNION ALL SELECT DISTINCT camera_id, frame_idx, NULL, NULL, NULL, NULL, 480, frame_idx / 10 FROM tracks WHERE frame_idx % 50 <> 3 AND frame_idx % 20 = 7
""")
def s1_read_track_messages(v: Views) -> DataFrame:
    rows = messages.read_track_messages(track_json(v), keep=["camera_id"])
    return rows.select("camera_id", "frame_idx", "tracker_id", "x1", "y2", rounded("confidence"), "frame_h", "stamp")


@registered("SELECT camera_id, frame_idx % 50 = 3 AS is_bad, count(DISTINCT frame_idx) AS n FROM tracks GROUP BY 1, 2")
def s2_split_bad_json(v: Views) -> DataFrame:
    good, bad = messages.split_bad_json(track_json(v), schemas.TRACK_MESSAGE)
    both = good.select("camera_id", F.lit(False).alias("is_bad")).unionByName(bad.select("camera_id", F.lit(True).alias("is_bad")))
    return both.groupBy("camera_id", "is_bad").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT request_id, 'img' || CAST(query_id AS VARCHAR) AS image FROM requests WHERE query_id % 4 <> 0")
def s3_read_find_requests(v: Views) -> DataFrame:
    image = F.when(F.col("query_id") % 4 != 0, messages.encoded(F.encode(F.concat(F.lit("img"), F.col("query_id").cast("string")), "UTF-8")))
    raw = v.requests.select(F.to_json(F.struct("request_id", image.alias("image_jpeg_b64"))).alias("value"))
    return messages.read_find_requests(raw).select("request_id", F.decode("image", "UTF-8").alias("image"))


@registered("SELECT camera_id, frame_idx, CAST(frame_idx AS VARCHAR) AS frame, 480 AS frame_h, 640 AS frame_w, true AS has_frame FROM (SELECT DISTINCT camera_id, frame_idx FROM tracks) f WHERE frame_idx % 50 <> 3")
def s4_decode_frame_payload(v: Views) -> DataFrame:
    return messages.frame_payloads(track_json(v), keep=["camera_id"]).select("camera_id", "frame_idx", F.decode("frame", "UTF-8").alias("frame"), "frame_h", "frame_w", "has_frame")


@registered("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE to_base64(encode(coalesce(props, ''))) END AS payload FROM events")
def s5_encode_frame_payload(v: Views) -> DataFrame:
    data = F.when(F.col("event_id") % 5 != 0, F.encode(F.coalesce("props", F.lit("")), "UTF-8"))
    return v.events.select("event_id", messages.encoded(data).alias("payload"))


def identified_tracks(v: Views) -> DataFrame:
    """Tracks with an identity by rule, for the wire formats: det_seq, global_id, match_score, match_type."""
    return v.det.withColumns({"global_id": F.col("tracker_id") * 7 % 5 - 1, "match_score": F.round(F.col("confidence") / 2, 4), "match_type": F.lit("B"), "stamp": F.col("frame_idx") / 10})


@registered("SELECT camera_id, frame_idx, tracker_id, tracker_id * 7 % 5 - 1 AS global_id, CAST(x2 AS INT) AS x2, round(confidence, 4) AS confidence, 'B' AS match_type, row_number() OVER (PARTITION BY camera_id, frame_idx ORDER BY obs_id) - 1 AS place FROM tracks")
def s6_write_identity_messages(v: Views) -> DataFrame:
    sent = sinks.identity_messages(identified_tracks(v))
    back = sent.select("camera_id", F.from_json("value", schemas.IDENTITY_MESSAGE).alias("m"))
    rows = back.select("camera_id", "m.frame_idx", F.posexplode("m.tracks").alias("place", "t"))
    return rows.select("camera_id", "frame_idx", "t.tracker_id", "t.global_id", F.element_at("t.bbox", 3).alias("x2"), F.round("t.confidence", 4).alias("confidence"), "t.match_type", F.col("place").cast("long").alias("place"))


@registered("SELECT request_id, query_id % 7 - 1 AS global_id, CAST(-1 AS BIGINT) AS track_id, 'gid_only' AS method FROM requests")
def s7_write_find_results(v: Views) -> DataFrame:
    r = v.requests.select("request_id", (F.col("query_id") % 7 - 1).alias("global_id"), F.lit(-1).cast("long").alias("track_id"), F.lit(0.5).alias("score"), F.lit("gid_only").alias("method"))
    back = sinks.find_result_messages(r).select(F.from_json("value", schemas.FIND_RESULT).alias("m"))
    return back.select("m.request_id", "m.global_id", "m.track_id", "m.method")


@registered("SELECT entry_seq, CASE WHEN entry_seq % 7 = 0 THEN '' ELSE printf('/crops/gid%04d_f%07d.jpg', global_id, frame_idx) END AS crop_path FROM gallery")
def s8_write_gallery_crops(v: Views) -> DataFrame:
    return v.gallery.select("entry_seq", sinks.crop_path("/crops", F.col("global_id"), F.col("frame_idx"), there=F.col("entry_seq") % 7 != 0).alias("crop_path"))


@registered("SELECT entry_seq, global_id, frame_idx, CASE WHEN has_face THEN 'face' ELSE 'body' END AS kind FROM gallery")
def s9_read_gallery_crops(v: Views) -> DataFrame:
    g, f = F.col("global_id"), F.col("frame_idx")
    paths = v.gallery.select("entry_seq", F.when(F.col("has_face"), sinks.crop_path("/crops", g, f, face=True)).otherwise(sinks.crop_path("/crops", g, f)).alias("path"))
    return sinks.crop_names(paths).select("entry_seq", "global_id", "frame_idx", "kind")


@registered("SELECT entry_seq, entry_seq % 3 = 0 AS deleted FROM gallery")
def s10_prune_evicted_crops(v: Views) -> DataFrame:
    crops = v.gallery.select("camera_id", "entry_seq", sinks.crop_path("/c", F.col("entry_seq"), F.col("frame_idx")).alias("crop_path"))
    gone, kept = sinks.pruned_crops(crops, crops.filter("entry_seq % 3 <> 0"))
    return gone.select("entry_seq", F.lit(True).alias("deleted")).unionByName(kept.select("entry_seq", F.lit(False).alias("deleted")))


@registered("SELECT CAST(min(n_nationkey) AS INT) AS class_id FROM nation WHERE lower(n_name) = 'nation_13'")
def s12_target_class_id(v: Views) -> DataFrame:
    labels = v.nation.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v")))).alias("id2label"))
    return sinks.target_class_id(labels, "nation_13")


@registered("""
    WITH s AS (SELECT *, list_transform(logits, lambda x: 1 / (1 + exp(-x))) AS p FROM raw_detections),
    m AS (SELECT *, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 AS c FROM s)
    SELECT camera_id, query_idx, CAST(c AS INT) AS class_id, round(confidence, 5) AS confidence,
      round(least(greatest((box[1] - box[3] / 2) * frame_w, 0), frame_w), 5) AS x1, round(least(greatest((box[2] - box[4] / 2) * frame_h, 0), frame_h), 5) AS y1,
      round(least(greatest((box[1] + box[3] / 2) * frame_w, 0), frame_w), 5) AS x2, round(least(greatest((box[2] + box[4] / 2) * frame_h, 0), frame_h), 5) AS y2
    FROM m WHERE confidence > 0.5 AND c = 0
""")
def p1_decode_detections(v: Views) -> DataFrame:
    return detect.decode_detections(v.raw_detections).select("camera_id", "query_idx", "class_id", rounded("confidence"), *map(rounded, boxes.EDGES))


CROPS_SQL = """
    WITH b AS (SELECT obs_id, CAST(trunc(x1 - 60) AS INT) AS x1, CAST(trunc(y1 - 30) AS INT) AS y1, CAST(trunc(x2 - 60) AS INT) AS x2, CAST(trunc(y2 - 30) AS INT) AS y2 FROM tracks),
    c AS (SELECT obs_id, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(320, x2) AS x2, least(140, y2) AS y2 FROM b)
    SELECT obs_id, x1, y1, x2, y2, greatest(0, x2 - x1) AS w, greatest(0, y2 - y1) AS h, x2 <= x1 OR y2 <= y1 AS is_empty, x2 - x1 >= 4 AND y2 - y1 >= 4 AS embeddable FROM c
"""


@registered(CROPS_SQL)
def p3_crop_rect(v: Views) -> DataFrame:
    moved = v.tracks.select("obs_id", *[(F.col(e) - (60 if e[0] == "x" else 30)).alias(e) for e in boxes.EDGES], F.lit(320).alias("frame_w"), F.lit(140).alias("frame_h"))
    return detect.crops(moved).select("obs_id", "crop.*", "embeddable")


QUALITY_SQL = """CASE WHEN kps[6].c >= 0.5 AND kps[7].c >= 0.5 AND kps[12].c >= 0.5 AND kps[13].c >= 0.5 THEN 2
      WHEN kps[6].c >= 0.5 AND kps[7].c >= 0.5 AND (kps[1].c >= 0.5 OR kps[2].c >= 0.5 OR kps[3].c >= 0.5) THEN 1 ELSE 0 END"""


@registered(f"SELECT pose_seq, {QUALITY_SQL} AS quality FROM poses")
def p5_pose_quality(v: Views) -> DataFrame:
    return v.poses.select("pose_seq", pose.quality(F.col("kps"), DEFAULTS.pose_conf_threshold).alias("quality"))


@registered(f"SELECT pose_seq, round(x1 / 0.5, 5) AS x1, round(y2 / 0.5, 5) AS y2, round(kps[17].x / 0.5, 5) AS last_x, {QUALITY_SQL} AS quality FROM poses WHERE score >= 0.5")
def p6_filter_poses(v: Views) -> DataFrame:
    return pose.filter_poses(v.poses, 0.5).select("pose_seq", rounded("x1"), rounded("y2"), rounded("last_x", F.element_at("kps", 17)["x"]), "quality")


@registered("SELECT o_orderkey, round(least(640.0 / w, 640.0 / h), 8) AS scale, CAST(floor(w * least(640.0 / w, 640.0 / h)) AS INT) AS nw, CAST(floor(h * least(640.0 / w, 640.0 / h)) AS INT) AS nh FROM (SELECT o_orderkey, CAST(200 + o_orderkey % 900 AS DOUBLE) AS w, CAST(100 + o_custkey % 700 AS DOUBLE) AS h FROM orders) s")
def p7_letterbox_params(v: Views) -> DataFrame:
    b = boxes.letterbox((200 + F.col("o_orderkey") % 900).cast("double"), (100 + F.col("o_custkey") % 700).cast("double"), 640, 640, centred=True)
    return v.orders.select("o_orderkey", b.alias("b")).select("o_orderkey", rounded("scale", F.col("b.scale"), 8), "b.nw", "b.nh")


ANCHOR_SQL = "anchor_idx % (640 // stride) * stride AS ax, anchor_idx // (640 // stride) * stride AS ay"


@registered(f"SELECT stride, anchor_idx, {ANCHOR_SQL} FROM (SELECT DISTINCT stride FROM raw_faces) s, range(6400) r(anchor_idx) WHERE anchor_idx < (640 // stride) * (640 // stride)")
def p8_anchor_grid(v: Views) -> DataFrame:
    grid = detect.anchor_grid(v.raw_faces.select("stride").distinct())
    return grid.select("stride", F.col("anchor_idx").cast("long").alias("anchor_idx"), F.col("ax").cast("long").alias("ax"), F.col("ay").cast("long").alias("ay"))


@registered(f"""
    WITH a AS (SELECT *, {ANCHOR_SQL}, sqrt(1 / (1 + exp(-cls)) * (1 / (1 + exp(-obj)))) AS score FROM raw_faces)
    SELECT event_id, round(score, 5) AS score, round((ax + bbox[1] * stride - 3) / 0.5 - exp(bbox[3]) * stride / 0.5 / 2, 4) AS x1, round((ay + bbox[2] * stride - 5) / 0.5 + exp(bbox[4]) * stride / 0.5 / 2, 4) AS y2, round((ax + 0.2 * stride - 3) / 0.5, 4) AS eye_x
    FROM a WHERE score >= 0.65
""")
def p9_decode_faces(v: Views) -> DataFrame:
    found = detect.decode_faces(v.raw_faces, 0.5, 3, 5)
    return found.select("event_id", rounded("score"), rounded("x1", digits=4), rounded("y2", digits=4), rounded("eye_x", F.element_at("landmarks", 3)["x"], 4))


@registered("""
    WITH c AS (SELECT face_seq, greatest(0, x - 30) AS x1, greatest(0, y - 20) AS y1, least(400, x - 30 + w) AS x2, least(60, y - 20 + h) AS y2 FROM faces)
    SELECT face_seq, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM c WHERE x2 - x1 >= 10 AND y2 - y1 >= 10
""")
def p10_clip_faces(v: Views) -> DataFrame:
    f = v.faces.select("face_seq", (F.col("x") - 29.5).alias("x1"), (F.col("y") - 19.5).alias("y1"), (F.col("x") - 29.5 + F.col("w")).alias("x2"), (F.col("y") - 19.5 + F.col("h")).alias("y2"), F.lit(400).alias("frame_w"), F.lit(60).alias("frame_h"))
    f = f.withColumns({e: F.floor(e).cast("double") for e in boxes.EDGES})
    return detect.clip_faces(f).select("face_seq", "x", "y", "w", "h")


@registered("SELECT obs_id, obs_id % 4 = 3 OR obs_id % 4 IN (1, 2) AS qualifies, CASE obs_id % 4 WHEN 2 THEN 'F' WHEN 0 THEN '?' ELSE 'U' END AS letter FROM tracks")
def p11_qualifies(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["none", "upper_body", "full_body", "unknown"])), (F.col("obs_id") % 4 + 1).cast("int"))
    q = quality_number(name)
    return v.tracks.select("obs_id", pose.qualifies(q).alias("qualifies"), quality_letter(q).alias("letter"))


SUMMARY_SQL = "SELECT camera_id, global_id, count(*) AS n_entries, max(frame_idx) AS last_keyframe, max(pose_quality) AS best_quality, bool_or(has_face) AS has_face FROM gallery GROUP BY 1, 2"


@registered(f"""
    WITH g AS ({SUMMARY_SQL}), s AS (SELECT tracker_id AS global_id, max(frame_idx) AS last_seen FROM tracks WHERE tracker_id % 3 <> 0 GROUP BY 1)
    SELECT obs_id, t.obs_id % 3 >= 1 AND t.obs_id % 11 <> 0 AND (g.n_entries IS NULL OR coalesce(s.last_seen, g.last_keyframe - t.obs_id % 2) - (g.last_keyframe - t.obs_id % 2) >= 60 OR t.obs_id % 3 > g.best_quality) AS needs_keyframe
    FROM tracks t LEFT JOIN g ON g.global_id = t.tracker_id LEFT JOIN s ON s.global_id = t.tracker_id
""")
def p12_needs_keyframe(v: Views) -> DataFrame:
    c = v.tracks.select("obs_id", F.lit(0).cast("long").alias("camera_id"), F.col("tracker_id").alias("global_id"), (F.col("obs_id") % 3).cast("int").alias("pose_quality"), (F.col("obs_id") % 11 == 0).alias("crop_empty"))
    seen = v.tracks.filter("tracker_id % 3 <> 0").groupBy(F.lit(0).cast("long").alias("camera_id"), F.col("tracker_id").alias("global_id")).agg(F.max("frame_idx").alias("last_seen"))
    return gallery.needs_keyframe(c, gallery.gallery_summary(v.gallery), seen).select("obs_id", "needs_keyframe")


@registered("SELECT obs_id FROM tracks WHERE obs_id % 3 <> 0 AND (tracker_id = 4 OR obs_id % 5 = 0)")
def p13_needs_embedding(v: Views) -> DataFrame:
    o = v.tracks.select("obs_id", (F.col("obs_id") % 3 != 0).alias("qualifies"), F.when(F.col("tracker_id") != 4, F.col("tracker_id")).alias("global_id"), (F.col("obs_id") % 5 == 0).alias("needs_keyframe"))
    return gallery.needs_embedding(o).select("obs_id")


@registered("""
    SELECT c.obs_id, round(max(list_cosine_similarity(c.embedding, g.embedding)), 4) AS max_sim, c.pose_quality >= 1 AND (count(g.entry_seq) = 0 OR max(list_cosine_similarity(c.embedding, g.embedding)) < 0.85 OR c.pose_quality > max(g.pose_quality)) AS added
    FROM body_candidates c LEFT JOIN gallery g ON g.global_id = c.global_id GROUP BY c.obs_id, c.pose_quality
""")
def p14_novel_view(v: Views) -> DataFrame:
    return gallery.novel_view(v.body_candidates.withColumn("camera_id", F.lit(0).cast("long")), v.gallery, "obs_id").select("obs_id", rounded("max_sim", digits=4), "added")


@registered("SELECT obs_id, CAST(trunc(x1 - confidence) AS INT) AS x1, CAST(trunc(y1 + confidence) AS INT) AS y1 FROM tracks")
def p15_truncate_boxes(v: Views) -> DataFrame:
    b = boxes.truncated(F.struct((F.col("x1") - F.col("confidence")).alias("x1"), (F.col("y1") + F.col("confidence")).alias("y1"), "x2", "y2"))
    return v.tracks.select("obs_id", b["x1"].alias("x1"), b["y1"].alias("y1"))


@registered("""
    SELECT obs_id, CASE WHEN obs_id % 4 <> 0 THEN 'G' || CAST(obs_id % 9 AS VARCHAR) || ' T' || CAST(tracker_id AS VARCHAR) || ' ' || CASE obs_id % 3 WHEN 2 THEN 'F' WHEN 1 THEN 'U' ELSE '?' END || CASE WHEN obs_id % 2 = 0 THEN 'f' ELSE '' END
        || CASE obs_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' [NEW]' ELSE printf(' [%s %.2f]', 'F+B', (obs_id % 8) / 8.0) END || CASE WHEN obs_id % 6 > 2 THEN printf(' fs:%.2f', (obs_id % 6) / 8.0) ELSE '' END
      WHEN obs_id % 8 = 0 THEN 'buf' || CAST(obs_id % 5 AS VARCHAR) || '/5 T' || CAST(tracker_id AS VARCHAR) || CASE WHEN obs_id % 2 = 0 THEN 'f' ELSE '' END
      ELSE '? T' || CAST(tracker_id AS VARCHAR) END AS label FROM tracks
""")
def p16_track_label(v: Views) -> DataFrame:
    o = F.col("obs_id")
    kind = F.when(o % 5 == 1, "NEW").when(o % 5 > 1, "F+B")
    label = track_label(F.when(o % 4 != 0, o % 9), F.col("tracker_id"), (o % 3).cast("int"), o % 2 == 0, kind, (o % 8) / 8.0, F.when(o % 6 > 2, (o % 6) / 8.0), F.when(o % 8 == 0, o % 5), 5)
    return v.tracks.select("obs_id", label.alias("label"))


J1_SQL = f"""
    WITH p AS (SELECT camera_id, frame_idx, pose_seq, x1, y1, x2, y2, {QUALITY_SQL} AS quality FROM poses WHERE score >= 0.5),
    m AS (SELECT t.obs_id, p.pose_seq, p.quality, {overlap_sql("t.", "p.")} AS iou FROM tracks t JOIN p USING (camera_id, frame_idx)),
    r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY iou DESC, pose_seq) AS k FROM m WHERE iou >= 0.3)
    SELECT t.obs_id, r.pose_seq, round(r.iou, 5) AS pose_iou, coalesce(r.quality, 0) AS pose_quality FROM tracks t LEFT JOIN r ON r.obs_id = t.obs_id AND r.k = 1
"""


@registered(J1_SQL)
def j1_assign_poses(v: Views) -> DataFrame:
    return pose.assign_poses(v.tracks, pose.filter_poses(v.poses), "obs_id").select("obs_id", "pose_seq", rounded("pose_iou"), "pose_quality")


@registered(J1_SQL)
def j1_assign_poses_in_cells(v: Views) -> DataFrame:
    """As j1_assign_poses, with every frame of more than two boxes taken for a full one."""
    return pose.assign_poses(v.tracks, pose.filter_poses(v.poses), "obs_id", crowd=2).select("obs_id", "pose_seq", rounded("pose_iou"), "pose_quality")


J2_SQL = """
    WITH m AS (SELECT t.obs_id, f.face_seq, f.w * f.h AS a FROM tracks t JOIN faces f USING (camera_id, frame_idx)
      WHERE f.x + f.w // 2 BETWEEN trunc(t.x1) AND trunc(t.x2) AND f.y + f.h // 2 BETWEEN trunc(t.y1) AND trunc(t.y2)),
    r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY a DESC, face_seq) AS k FROM m)
    SELECT t.obs_id, r.face_seq, r.a AS face_area FROM tracks t LEFT JOIN r ON r.obs_id = t.obs_id AND r.k = 1
"""


@registered(J2_SQL)
def j2_assign_faces(v: Views) -> DataFrame:
    return faces.assign_faces(v.tracks, v.faces, "obs_id").select("obs_id", "face_seq", "face_area")


@registered(J2_SQL)
def j2_assign_faces_in_cells(v: Views) -> DataFrame:
    """As j2_assign_faces, with every frame of more than two boxes taken for a full one."""
    return faces.assign_faces(v.tracks, v.faces, "obs_id", crowd=2).select("obs_id", "face_seq", "face_area")


def track_map(v: Views) -> DataFrame:
    """Identities of some tracks by rule."""
    t = v.tracks.select("camera_id", "tracker_id").distinct().filter("(camera_id + tracker_id) % 4 <> 0")
    return t.withColumns({"global_id": F.col("tracker_id") * 3 % 7, "match_score": F.lit(0.9), "match_type": F.lit("F+B")})


@registered("SELECT obs_id, CASE WHEN (camera_id + tracker_id) % 4 <> 0 THEN tracker_id * 3 % 7 END AS global_id FROM tracks")
def j3_known_gid(v: Views) -> DataFrame:
    return assign.known_gid(v.tracks, track_map(v)).select("obs_id", "global_id")


SIMS_SQL = "s AS (SELECT q.query_id, g.global_id, max(list_cosine_similarity(q.body, g.embedding)) AS score, min(g.entry_seq) AS first_seq FROM queries q, gallery g GROUP BY 1, 2)"


def sims(v: Views) -> DataFrame:
    return match.all_top1_sims(v.queries, v.gallery, vector="body")


@registered(f"WITH {SIMS_SQL} SELECT query_id, global_id, round(score, 5) AS score FROM s")
def a3_all_top1_sims(v: Views) -> DataFrame:
    return sims(v).select("query_id", "global_id", rounded("score"))


@registered(f"WITH {SIMS_SQL} SELECT query_id, global_id, round(score, 5) AS score FROM s WHERE (query_id + global_id) % 3 <> 0")
def j4_exclude_active(v: Views) -> DataFrame:
    active = v.queries.select("camera_id", "query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("global_id")).filter("(query_id + global_id) % 3 = 0")
    return match.exclude_active(sims(v), active).select("query_id", "global_id", rounded("score"))


@registered(f"""
    WITH {SIMS_SQL}, known(global_id, x1, y1, x2, y2) AS (VALUES {", ".join(f"({k}, {8 * k}, 0, {8 * k + 40}, 100)" for k in range(6))}),
    gate AS (SELECT q.query_id, l.global_id, {overlap_sql("q.", "l.")} AS iou FROM (SELECT query_id, query_id % 50 AS x1, 0 AS y1, query_id % 50 + 40 AS x2, 100 AS y2 FROM queries) q CROSS JOIN known l)
    SELECT query_id, global_id, round(score, 5) AS score FROM s WHERE global_id >= 6
    UNION ALL SELECT s.query_id, s.global_id, round(s.score, 5) FROM s JOIN gate USING (query_id, global_id) WHERE gate.iou >= 0.4
""")
def j5_iou_gate(v: Views) -> DataFrame:
    q = v.queries.select("camera_id", "query_id", (F.col("query_id") % 50).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("query_id") % 50 + 40).cast("double").alias("x2"), F.lit(100.0).alias("y2"))
    last = v.gallery.select("camera_id", "global_id").distinct().filter("global_id < 6").select("camera_id", "global_id", (F.col("global_id") * 8).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("global_id") * 8 + 40).cast("double").alias("x2"), F.lit(100.0).alias("y2"))
    return match.iou_gate(sims(v), q, last, Params(iou_gate_threshold=0.4)).select("query_id", "global_id", rounded("score"))


TOP1_SQL = "SELECT query_id, arg_max(global_id, score) AS global_id, round(max(score), 5) AS score FROM s GROUP BY 1 HAVING max(score) >= 0.82"


@registered(f"WITH {SIMS_SQL} {TOP1_SQL}")
def j6_match_top1(v: Views) -> DataFrame:
    return match.match(v.queries, v.gallery, vector="body").select("query_id", "global_id", rounded("score"))


@registered(f"WITH {SIMS_SQL} {TOP1_SQL}")
def j6_match_by_pivots(v: Views) -> DataFrame:
    """As j6_match_top1, with a gallery that is clustered by pivots whatever its size."""
    scores = match.all_top1_sims(v.queries, v.gallery, vector="body", least=DEFAULTS.sim_threshold, pivot_from=1)
    best = match.top1_per_group(scores.filter(F.col("score") >= DEFAULTS.sim_threshold), ["camera_id", "query_id"], "score", "first_seq")
    return best.select("query_id", "global_id", rounded("score"))


CENTROID_SQL = """u AS (SELECT global_id, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding) AS x FROM {0}), m AS (SELECT global_id, d, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT global_id, list(x ORDER BY d) AS e FROM m GROUP BY 1)"""


@registered(f"WITH {CENTROID_SQL.format('gallery')}, s AS (SELECT q.query_id, c.global_id, list_cosine_similarity(q.body, c.e) AS score FROM queries q, c) SELECT query_id, arg_max(global_id, score) AS global_id, round(max(score), 5) AS score FROM s GROUP BY 1 HAVING max(score) >= 0.15")
def j7_match_centroid(v: Views) -> DataFrame:
    return match.match(v.queries, v.gallery, Params(match_strategy="centroid", sim_threshold=0.15), vector="body").select("query_id", "global_id", rounded("score"))


def fused_sql(strategy: str) -> str:
    part = "WHERE g.has_face" if strategy == "face_body_face_gallery" else ""
    score = "coalesce(f, 0.0)" if strategy == "face_only_top1" else "(coalesce(f, 0.0) + coalesce(b, 0.0)) / ((f IS NOT NULL)::INT + (b IS NOT NULL)::INT)"
    return f"""
    WITH q AS (SELECT * FROM queries WHERE face IS NOT NULL), i AS (SELECT DISTINCT global_id FROM gallery UNION SELECT DISTINCT global_id FROM face_gallery),
    f AS (SELECT q.query_id, g.global_id, max(list_cosine_similarity(q.face, g.embedding)) AS f FROM q, face_gallery g GROUP BY 1, 2),
    b AS (SELECT q.query_id, g.global_id, max(list_cosine_similarity(q.body, g.embedding)) AS b FROM q, gallery g {part} GROUP BY 1, 2),
    s AS (SELECT query_id, global_id, {score} AS score FROM (SELECT query_id, global_id FROM q, i) x LEFT JOIN f USING (query_id, global_id) LEFT JOIN b USING (query_id, global_id) {"" if strategy == "face_only_top1" else "WHERE f IS NOT NULL OR b IS NOT NULL"}),
    fused AS (SELECT query_id, arg_min(global_id, (-score, global_id)) AS global_id, max(score) AS score FROM s GROUP BY 1 HAVING max(score) >= {0.35 if strategy == "face_only_top1" else 0.82}),
    alone AS (SELECT query_id, arg_max(global_id, score) AS global_id, max(score) AS score FROM (SELECT q.query_id, g.global_id, max(list_cosine_similarity(q.body, g.embedding)) AS score FROM queries q, gallery g WHERE q.face IS NULL GROUP BY 1, 2) y GROUP BY 1 HAVING max(score) >= 0.82)
    SELECT query_id, global_id, round(score, 5) AS score FROM (SELECT * FROM fused UNION ALL SELECT * FROM alone) z
    """


def _fused(strategy: str):
    def run(v: Views) -> DataFrame:
        return match.match_with_face(v.queries, v.gallery, v.face_gallery, Params(face_match_strategy=strategy)).select("query_id", "global_id", rounded("score"))

    run.__name__ = f"j9_{strategy}"
    registered(fused_sql(strategy))(run)


for _s in ("face_only_top1", "face_top1_dino_top1_avg", "face_body_all_gallery", "face_body_face_gallery"):
    _fused(_s)


@registered(f"WITH {CENTROID_SQL.format('split_gallery')} SELECT a.global_id AS source, arg_max(b.global_id, list_cosine_similarity(a.e, b.e)) AS target, round(max(list_cosine_similarity(a.e, b.e)), 5) AS score FROM c a JOIN c b ON b.global_id < a.global_id GROUP BY 1 HAVING max(list_cosine_similarity(a.e, b.e)) >= 0.9")
def j10_merge_candidates(v: Views) -> DataFrame:
    return merge.merge_candidates(v.split_gallery).select("source", "target", rounded("score"))


@registered("""
    WITH f AS (SELECT DISTINCT camera_id, frame_idx FROM tracks WHERE frame_idx % 7 <> 0)
    SELECT r.camera_id, r.request_id, max(f.frame_idx) AS active_frame FROM requests r LEFT JOIN f ON f.camera_id = r.camera_id AND f.frame_idx <= r.frame_idx GROUP BY 1, 2
""")
def j12_active_as_of(v: Views) -> DataFrame:
    return lookup.active_as_of(v.requests, v.tracks.filter("frame_idx % 7 <> 0"))


@registered("SELECT obs_id, CASE WHEN (camera_id + tracker_id) % 4 <> 0 THEN tracker_id * 3 % 7 ELSE -1 END AS global_id, CASE WHEN (camera_id + tracker_id) % 4 <> 0 THEN 0.9 ELSE 0.0 END AS match_score, CASE WHEN (camera_id + tracker_id) % 4 <> 0 THEN 'F+B' ELSE 'B' END AS match_type FROM tracks")
def j13_enrich_tracks(v: Views) -> DataFrame:
    return assign.enrich_tracks(v.tracks, track_map(v)).select("obs_id", "global_id", "match_score", "match_type")


def remap_of(v: Views) -> DataFrame:
    """Some identities go over into others: 1 into 0, 3 into 2, 7 into 6."""
    return v.gallery.select("camera_id", F.col("global_id").alias("source")).distinct().filter("source IN (1, 3, 7)").withColumn("target", F.col("source") - 1)


@registered("SELECT entry_seq, CASE WHEN global_id IN (1, 3, 7) THEN global_id - 1 ELSE global_id END AS global_id FROM gallery")
def j14_remap_gids(v: Views) -> DataFrame:
    return merge.remap_gids(v.gallery, remap_of(v)).select("entry_seq", "global_id")


@registered("SELECT obs_id, tracker_id = 4 AS matched, CASE WHEN tracker_id = 4 THEN CAST(2 AS BIGINT) END AS found_gid, CASE WHEN tracker_id = 4 THEN 'track_gid' END AS found_method FROM tracks")
def j15_flag_matched_track(v: Views) -> DataFrame:
    result = v.tracks.select("camera_id").distinct().select("camera_id", F.lit(4).cast("long").alias("track_id"), F.lit(2).cast("long").alias("global_id"), F.lit(0.9).alias("score"), F.lit("track_gid").alias("method"))
    return lookup.flag_matched_track(v.tracks, result).select("obs_id", "matched", "found_gid", "found_method")


@registered("""
    WITH a AS (SELECT request_id, query_id % 5 AS global_id, camera_id AS arrived FROM requests WHERE query_id % 6 <> 0)
    SELECT r.request_id, r.camera_id, x.global_id FROM requests r LEFT JOIN (SELECT request_id, arg_max(global_id, arrived) AS global_id FROM a GROUP BY 1) x USING (request_id)
""")
def j16_correlate_lookup(v: Views) -> DataFrame:
    answers = v.requests.filter("query_id % 6 <> 0").select("request_id", (F.col("query_id") % 5).alias("global_id"), F.col("camera_id").alias("arrived"))
    return lookup.correlate_lookup(v.requests.select("request_id", "camera_id"), answers).select("request_id", "camera_id", "global_id")


@registered(f"WITH {CENTROID_SQL.format('gallery')}, n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM c) SELECT global_id, round(e[1] / l, 5) AS first, round(e[64] / l, 5) AS last FROM n")
def a1_centroids(v: Views) -> DataFrame:
    return match.centroids(v.gallery).select("global_id", rounded("first", F.element_at("embedding", 1)), rounded("last", F.element_at("embedding", 64)))


RUNS_SQL = """
    f AS (SELECT camera_id, frame_idx, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx) AS frame_seq FROM (SELECT DISTINCT camera_id, frame_idx FROM tracks) d),
    r AS (SELECT t.*, f.frame_seq, f.frame_seq - row_number() OVER (PARTITION BY t.camera_id, t.tracker_id ORDER BY t.frame_idx) AS run, t.obs_id % 7 <> 0 AS qualifies, t.obs_id % 28 = 0 AS has_face FROM tracks t JOIN f ON f.camera_id = t.camera_id AND f.frame_idx = t.frame_idx),
    c AS (SELECT *, sum(qualifies::INT) OVER w AS seen, max((NOT qualifies AND has_face)::INT) OVER w AS face FROM r WINDOW w AS (PARTITION BY camera_id, tracker_id, run ORDER BY frame_idx)),
    k AS (SELECT *, coalesce(max(greatest(face, (seen >= 5)::INT)) OVER (PARTITION BY camera_id, tracker_id, run ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c)
"""


def runs(v: Views) -> DataFrame:
    marked = v.tracks.withColumns({"qualifies": F.col("obs_id") % 7 != 0, "has_face": F.col("obs_id") % 28 == 0})
    return tracklets.pending_runs(marked)


@registered(f"""
    WITH {RUNS_SQL}, e AS (SELECT camera_id, tracker_id, run, frame_idx AS confirm_frame FROM k WHERE seen >= 5 AND face = 0 AND done = 0),
    x AS (SELECT e.*, unnest(range(1, 65)) AS d, unnest(b.embedding) AS y FROM e JOIN k USING (camera_id, tracker_id, run) JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.qualifies AND k.frame_idx <= e.confirm_frame),
    m AS (SELECT camera_id, tracker_id, run, confirm_frame, d, avg(CAST(y AS DOUBLE)) AS y, count(*) AS n FROM x GROUP BY ALL)
    SELECT camera_id, tracker_id, confirm_frame, min(n) AS n_embeddings, round(max(CASE WHEN d = 1 THEN y END) / sqrt(sum(y * y)), 4) AS first FROM m GROUP BY camera_id, tracker_id, run, confirm_frame
""")
def a2_mean_embedding(v: Views) -> DataFrame:
    c = tracklets.confirm_points(runs(v)).join(v.embeddings.select("vec_id", "embedding"), "vec_id")
    return tracklets.mean_embeddings(c, "embedding").select("camera_id", "tracker_id", "confirm_frame", "n_embeddings", rounded("first", F.element_at("mean_embedding", 1), 4))


@registered("SELECT q.query_id, round(coalesce(max(list_cosine_similarity(q.body, g.embedding)), 0.0), 5) AS score FROM queries q LEFT JOIN gallery g ON g.global_id = q.true_gid GROUP BY 1")
def a4_top1_sim(v: Views) -> DataFrame:
    return match.top1_sim(v.queries.withColumn("global_id", F.col("true_gid").cast("long")), v.gallery, vector="body").select("query_id", rounded("score"))


@registered("SELECT crop_a, crop_b, CASE WHEN crop_a % 13 = 5 THEN 1.0 ELSE count(*) / 1024.0 END AS match_rate FROM kp_matches GROUP BY 1, 2")
def a5_match_rate(v: Views) -> DataFrame:
    pairs = v.kp_matches.select("crop_a", "crop_b").distinct().withColumn("empty", F.col("crop_a") % 13 == 5)
    return gallery.match_rate(v.kp_matches, pairs)


@registered("SELECT a.entry_seq, round((sum(list_dot_product(a.embedding, b.embedding)) - 1.0) / greatest(count(*) - 1, 1), 5) + 0.0 AS centrality FROM gallery a JOIN gallery b ON a.global_id = b.global_id GROUP BY 1")
def a6_centrality(v: Views) -> DataFrame:
    return gallery.centrality(v.gallery).select("entry_seq", (F.round("centrality", 5) + 0.0).alias("centrality"))  # no -0.0


@registered(SUMMARY_SQL)
def a7_gallery_summary(v: Views) -> DataFrame:
    return gallery.gallery_summary(v.gallery)


@registered("SELECT camera_id, tracker_id AS global_id, max(frame_idx) AS last_seen, arg_max(x1, (frame_idx, obs_id)) FILTER (obs_id % 4 <> 0) AS x1, arg_max(y2, (frame_idx, obs_id)) FILTER (obs_id % 4 <> 0) AS y2 FROM tracks GROUP BY 1, 2")
def a8_gid_state(v: Views) -> DataFrame:
    o = v.det.withColumnRenamed("tracker_id", "global_id").withColumn("x1", F.when(F.col("det_seq") % 4 != 0, F.col("x1")))
    return gallery.gid_state(o).select("camera_id", "global_id", "last_seen", "x1", "y2")


@registered("""
    WITH s AS (SELECT camera_id, tracker_id AS global_id, max(frame_idx) AS last_seen, arg_max(x1, frame_idx) AS x1 FROM tracks GROUP BY 1, 2),
    m AS (SELECT camera_id, CASE WHEN global_id IN (1, 3, 7) THEN global_id - 1 ELSE global_id END AS target, global_id, last_seen, CASE WHEN global_id % 4 <> 2 THEN x1 END AS x1 FROM s)
    SELECT camera_id, target AS global_id, max(last_seen) AS last_seen, coalesce(max(CASE WHEN global_id = target THEN x1 END), max(CASE WHEN global_id <> target THEN x1 END)) AS x1 FROM m GROUP BY 1, 2
""")
def a9_merge_state(v: Views) -> DataFrame:
    s = gallery.gid_state(v.det.withColumnRenamed("tracker_id", "global_id"))
    s = s.withColumns({e: F.when(F.col("global_id") % 4 != 2, F.col(e)) for e in boxes.EDGES})
    remap = s.select("camera_id", F.col("global_id").alias("source")).filter("source IN (1, 3, 7)").withColumn("target", F.col("source") - 1)
    return merge.merge_state(s, remap).select("camera_id", "global_id", "last_seen", "x1")


FRAMES_SQL = "SELECT camera_id, frame_idx, count(*) AS n_detections, count(*) FILTER (obs_id % 3 = 0) AS n_embedded, count(*) FILTER ((camera_id + tracker_id) % 4 <> 0) AS n_identified FROM tracks GROUP BY 1, 2"


def frames(v: Views) -> DataFrame:
    return report.frame_summary(assign.known_gid(v.tracks, track_map(v)).withColumn("embedded", F.col("obs_id") % 3 == 0))


@registered(FRAMES_SQL)
def a10_frame_summary(v: Views) -> DataFrame:
    return frames(v)


@registered(f"WITH s AS ({FRAMES_SQL}) SELECT camera_id, frame_idx // 30 AS \"window\", count(*) AS n_frames, CAST(sum(n_detections) AS BIGINT) AS n_detections, CAST(sum(n_embedded) AS BIGINT) AS n_embedded, round(avg(n_detections), 5) AS mean_detections FROM s GROUP BY 1, 2")
def a11_stage_metrics(v: Views) -> DataFrame:
    return report.stage_metrics(frames(v)).withColumn("mean_detections", F.round("mean_detections", 5))


@registered("SELECT camera_id, frame_idx, bool_or((camera_id + tracker_id) % 4 = 0 OR obs_id % 9 < 5 OR obs_id % 10 = 0) AS needs_pose FROM tracks GROUP BY 1, 2")
def a12_frame_needs_pose(v: Views) -> DataFrame:
    o = v.tracks.select(*CAM, ((F.col("camera_id") + F.col("tracker_id")) % 4 != 0).alias("known"), (F.col("obs_id") % 9).alias("stable_count"), F.when(F.col("obs_id") % 10 != 0, F.lit(1)).alias("cached_quality"))
    return pose.frame_needs_pose(o)


@registered("SELECT DISTINCT camera_id, global_id FROM gallery WHERE global_id IN (SELECT global_id FROM face_gallery)")
def a13_has_entries(v: Views) -> DataFrame:
    return gallery.has_entries(v.gallery.select("camera_id", "global_id").distinct(), v.face_gallery)


W1_SQL = f"b AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM tracks WINDOW w AS (PARTITION BY camera_id, tracker_id ORDER BY frame_idx)), i AS (SELECT *, CASE WHEN px1 IS NOT NULL THEN {overlap_sql('', 'p')} END AS prev_iou FROM b)"


@registered(f"WITH {W1_SQL} SELECT obs_id, round(prev_iou, 5) AS prev_iou FROM i")
def w1_prev_bbox_iou(v: Views) -> DataFrame:
    return tracklets.prev_bbox_iou(v.tracks).select("obs_id", rounded("prev_iou"))


@registered(f"""
    WITH {W1_SQL}, s AS (SELECT *, coalesce(frame_idx > 20 AND prev_iou >= 0.7, false) AS still FROM i),
    g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS island FROM s)
    SELECT obs_id, CAST(sum(still::INT) OVER (PARTITION BY camera_id, tracker_id, island ORDER BY frame_idx) AS BIGINT) AS stable_count FROM g
""")
def w2_stable_count(v: Views) -> DataFrame:
    rows = tracklets.prev_bbox_iou(v.tracks).withColumn("known_before", F.col("frame_idx") > 20)
    return tracklets.stable_count(rows).select("obs_id", "stable_count")


@registered(f"WITH {RUNS_SQL} SELECT obs_id, frame_seq, run FROM r")
def w3_pending_runs(v: Views) -> DataFrame:
    return runs(v).select("obs_id", F.col("frame_seq").cast("long").alias("frame_seq"), F.col("run").cast("long").alias("run"))


@registered(f"WITH {RUNS_SQL} SELECT obs_id, CAST(seen AS BIGINT) AS seen, seen >= 5 AND face = 0 AND done = 0 AS confirms, face = 1 AND seen < 5 AND done = 0 AS face_ends_wait FROM k")
def w4_confirm_point(v: Views) -> DataFrame:
    return tracklets.confirm_points(runs(v)).select("obs_id", "seen", "confirms", "face_ends_wait")


@registered(f"WITH {RUNS_SQL} SELECT obs_id, last_value(CASE WHEN qualifies AND obs_id % 4 = 0 THEN obs_id END IGNORE NULLS) OVER (PARTITION BY camera_id, tracker_id, run ORDER BY frame_idx) AS latest_face FROM r")
def w5_latest_face(v: Views) -> DataFrame:
    rows = runs(v).withColumn("face", F.when(F.col("obs_id") % 4 == 0, F.col("obs_id")))
    return tracklets.latest_face(rows, "face").select("obs_id", "latest_face")


@registered("SELECT obs_id, last_value(CASE WHEN obs_id % 5 = 0 THEN obs_id % 3 END IGNORE NULLS) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS cached_quality FROM tracks")
def w6_pose_locf(v: Views) -> DataFrame:
    rows = v.tracks.withColumn("pose_quality", F.when(F.col("obs_id") % 5 == 0, F.col("obs_id") % 3))
    return pose.last_known_quality(rows).select("obs_id", "cached_quality")


def completions(v: Views) -> DataFrame:
    return v.det.select(*CAM, "tracker_id", "det_seq", F.when(F.col("det_seq") % 3 != 0, (F.col("det_seq") % 7) / 7.0).alias("prescore"))


PLACE_SQL = "row_number() OVER (PARTITION BY camera_id, frame_idx ORDER BY CASE WHEN obs_id % 3 <> 0 THEN (obs_id % 7) / 7.0 ELSE 0.0 END DESC, obs_id)"


@registered(f"SELECT obs_id AS det_seq, {PLACE_SQL} AS place FROM tracks")
def w7_rank_completions(v: Views) -> DataFrame:
    return assign.rank_completions(completions(v)).select("det_seq", F.col("place").cast("long").alias("place"))


@registered(f"""
    WITH p AS (SELECT camera_id, frame_idx, obs_id, {PLACE_SQL} AS place FROM tracks),
    n AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx, place) - 1 AS k FROM p WHERE obs_id % 5 = 0)
    SELECT obs_id AS det_seq, camera_id + 10 + k AS global_id FROM n
""")
def w8_new_gid_numbers(v: Views) -> DataFrame:
    rows = assign.rank_completions(completions(v)).withColumn("global_id", F.when(F.col("det_seq") % 5 != 0, F.lit(1).cast("long")))
    highest = v.tracks.select("camera_id").distinct().withColumn("highest", F.col("camera_id") + 9)
    return assign.new_gid_numbers(rows, highest).filter("is_new").select("det_seq", "global_id")


@registered("SELECT obs_id, frame_idx - last_value(CASE WHEN obs_id % 6 = 0 THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS keyframe_gap FROM tracks")
def w9_keyframe_gap(v: Views) -> DataFrame:
    rows = v.tracks.withColumns({"global_id": F.col("tracker_id"), "is_keyframe": F.col("obs_id") % 6 == 0})
    return tracklets.keyframe_gap(rows).select("obs_id", "keyframe_gap")


@registered("SELECT camera_id, frame_idx, arg_max(obs_id, (confidence, -obs_id)) AS obs_id FROM tracks GROUP BY 1, 2")
def o1_top1_per_group(v: Views) -> DataFrame:
    return match.top1_per_group(v.tracks.select(*CAM, "obs_id", "confidence"), CAM, "confidence", "obs_id").select(*CAM, "obs_id")


@registered("""
    WITH f AS (SELECT DISTINCT camera_id, frame_idx FROM tracks), p AS (SELECT camera_id, frame_idx, arg_max(x1, ((x2 - x1) * (y2 - y1) + obs_id % 5, -tracker_id)) AS x1 FROM tracks WHERE frame_idx % 6 <> 0 GROUP BY 1, 2)
    SELECT f.camera_id, f.frame_idx, coalesce(p.x1, 0.0) AS x1 FROM f LEFT JOIN p USING (camera_id, frame_idx)
""")
def o2_largest_person(v: Views) -> DataFrame:
    every = v.tracks.select(*CAM).distinct().withColumns({"frame_w": F.lit(640), "frame_h": F.lit(480)})
    wider = v.tracks.filter("frame_idx % 6 <> 0").withColumn("y2", F.col("y2") + (F.col("obs_id") % 5) / (F.col("x2") - F.col("x1")))
    return sinks.largest_person(every, wider).select(*CAM, "x1")


@registered(f"SELECT camera_id, frame_idx, arg_max({QUALITY_SQL}, (score, -pose_seq)) AS pose_quality FROM poses WHERE score >= 0.5 GROUP BY 1, 2")
def o3_best_pose(v: Views) -> DataFrame:
    return pose.best_pose(pose.filter_poses(v.poses).withColumn("pose_quality", F.col("quality")), CAM)


@registered(folds.NMS)
def o4_nms_faces(v: Views) -> DataFrame:
    found = detect.decode_faces(v.raw_faces).select("frame_idx", "event_id", "score", *boxes.EDGES)
    return detect.nms_faces(found, ["frame_idx"], "event_id").select("frame_idx", "event_id", rounded("score"))


@registered(folds.GREEDY)
def o5_greedy_assign(v: Views) -> DataFrame:
    f = v.queries.select((F.col("query_id") % 40).alias("frame_idx"), "camera_id", F.col("query_id").alias("tracker_id"), F.col("query_id").alias("det_seq"), "query_id")
    scores = match.all_top1_sims(v.queries, v.gallery, vector="body", least=0.1).join(f.select("query_id", "frame_idx", "tracker_id"), "query_id")
    best = scores.groupBy("tracker_id").agg(F.max("score").alias("prescore"))
    done = assign.greedy_assign(scores, f.join(best, "tracker_id", "left"), Params(sim_threshold=0.1))
    return done.select("frame_idx", "tracker_id", "global_id", rounded("match_score"))


@registered(f"WITH {SIMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seq) AS k FROM s) SELECT query_id, CAST(k AS INT) AS rank, global_id, round(score, 5) AS score FROM r WHERE k <= 3")
def o6_rank_gallery(v: Views) -> DataFrame:
    return match.rank_gallery(sims(v), 3).select("query_id", "rank", "global_id", rounded("score"))


@registered("""
    WITH c AS (SELECT a.global_id, a.entry_seq, round((sum(list_dot_product(a.embedding, b.embedding)) - 1.0) / greatest(count(*) - 1, 1), 12) AS x FROM gallery a JOIN gallery b ON a.global_id = b.global_id GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY x DESC, entry_seq) AS k FROM c) SELECT global_id, entry_seq FROM r WHERE k > 1
""")
def o7_evict_most_central(v: Views) -> DataFrame:
    return gallery.evict_most_central(v.gallery).select("global_id", "entry_seq")


@registered("SELECT DISTINCT camera_id, global_id FROM (SELECT camera_id, global_id FROM gallery UNION ALL SELECT camera_id, global_id FROM face_gallery) u")
def u1_candidate_gids(v: Views) -> DataFrame:
    return match.candidate_gids(v.gallery, v.face_gallery)


@registered("SELECT obs_id FROM tracks t WHERE EXISTS (SELECT 1 FROM tracks u WHERE u.camera_id = t.camera_id AND u.tracker_id = t.tracker_id AND u.frame_idx = (SELECT max(frame_idx) FROM tracks m WHERE m.camera_id = t.camera_id))")
def u2_drop_stale_pending(v: Views) -> DataFrame:
    last = v.tracks.groupBy("camera_id").agg(F.max("frame_idx").alias("frame_idx"))
    return tracklets.drop_stale_pending(v.tracks, v.tracks.join(last, CAM, "left_semi")).select("obs_id")


@registered(folds.MERGED)
def u3_merge_entries(v: Views) -> DataFrame:
    return gallery.merge_entries(v.gallery, remap_of(v)).select("camera_id", "global_id", "entry_seq", "frame_idx")


@registered(f"SELECT t.obs_id, round({overlap_sql('t.', 'p.')}, 5) AS iou, round((t.x2 - t.x1) * (t.y2 - t.y1), 5) AS area FROM tracks t JOIN poses p ON p.pose_seq = t.obs_id")
def c1_bbox_iou(v: Views) -> DataFrame:
    p = v.poses.select("pose_seq", boxes.box().alias("p"))
    return v.tracks.join(p, F.col("obs_id") == F.col("pose_seq")).select("obs_id", rounded("iou", boxes.iou(boxes.box(), F.col("p"))), rounded("area", boxes.area(boxes.box())))


@registered("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS turned, round(1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))), 6) AS squashed FROM embeddings")
def c2_vectors(v: Views) -> DataFrame:
    e = F.col("embedding")
    return v.embeddings.select("vec_id", rounded("first", F.element_at(l2_normalize(e), 1), 6), rounded("turned", cosine(e, F.reverse(e))), rounded("squashed", sigmoid(F.element_at(e, 2).cast("double")), 6))


@registered("SELECT face_seq, CAST(x + w // 2 AS BIGINT) AS cx, CAST(y + h // 2 AS BIGINT) AS cy FROM faces")
def c4_box_center(v: Views) -> DataFrame:
    c = boxes.face_centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return v.faces.select("face_seq", c["x"].alias("cx"), c["y"].alias("cy"))


@registered("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first FROM embeddings GROUP BY 1")
def x4_vector_mean(v: Views) -> DataFrame:
    return v.embeddings.groupBy("label").agg(rounded("first", F.element_at(mean_vector(F.col("embedding")), 1), 6))


def observations(v: Views) -> DataFrame:
    """Tracks with pose quality, body and face, for the whole identity step."""
    posed = pose.assign_poses(v.det, pose.filter_poses(v.poses), "det_seq")
    faced = faces.assign_faces(posed, v.faces, "det_seq")
    body = v.embeddings.select(F.col("vec_id").alias("_b"), F.transform("embedding", lambda x: x.cast("double")).alias("body"))
    face = v.embeddings.select(F.col("vec_id").alias("_f"), F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("face"))
    rows = faced.withColumns({"_b": F.col("tracker_id") * 25 + F.expr("(det_seq div 997) % 3"), "_f": F.when(F.col("face_seq").isNotNull(), F.col("tracker_id") * 25 + 7)})
    return rows.join(body, "_b", "left").join(face, "_f", "left").drop("_b", "_f")


@registered()
def t1_identify(v: Views) -> DataFrame:
    done = identify(observations(v))
    return done.select("camera_id", "frame_idx", "tracker_id", "global_id", rounded("match_score"), "match_type", "stable_count")


@registered(folds.BODY)
def t2_update_body_gallery(v: Views) -> DataFrame:
    done = gallery.update_body_gallery(v.body_candidates.withColumn("has_face", F.col("obs_id") % 2 == 0))
    return done.select("camera_id", "global_id", "entry_seq", "frame_idx", "pose_quality")


@registered(folds.FACE)
def t3_update_face_gallery(v: Views) -> DataFrame:
    f = v.body_candidates.select("camera_id", "global_id", "frame_idx", F.col("obs_id").alias("face_seq"), F.slice("embedding", 1, 32).alias("embedding"))
    return gallery.update_face_gallery(f).select("camera_id", "global_id", "face_seq", "added", rounded("face_sim"))


@registered("WITH RECURSIVE e AS (SELECT DISTINCT user_id AS source, user_id // 3 AS target FROM events WHERE user_id > 0), r(source, target) AS (SELECT source, target FROM e UNION ALL SELECT r.source, e.target FROM r JOIN e ON e.source = r.target) SELECT source, min(target) AS target FROM r GROUP BY 1")
def t5_merge_roots(v: Views) -> DataFrame:
    edges = v.events.filter("user_id > 0").select(F.lit(0).cast("long").alias("camera_id"), F.col("user_id").alias("source"), F.expr("user_id div 3").alias("target")).distinct()
    return merge.roots(edges).select("source", "target")


@registered()
def t8_link_tracks(v: Views) -> DataFrame:
    d = v.tracks.select(*CAM, "obs_id", *boxes.EDGES, "confidence")
    return tracklets.link_tracks(d, "obs_id").select("camera_id", "frame_idx", "obs_id", "tracker_id")


def asked_in_frames(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests with their vectors, the tracks that are active in each, and one that waits in some."""
    asked = v.requests.join(v.queries.select("query_id", "body", "face"), "query_id").select(F.lit(0).cast("long").alias("camera_id"), F.concat("request_id", F.lit("@"), F.col("camera_id").cast("string")).alias("request_id"), F.when(F.col("query_id") % 9 != 0, F.col("body")).alias("body"), "face")
    active = asked.select("camera_id", "request_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("tracker_id")).withColumns({"global_id": F.col("tracker_id") % 4, "det_seq": F.col("tracker_id")})
    waiting = asked.select("camera_id", "request_id", F.lit(77).cast("long").alias("tracker_id"), F.col("body").alias("embedding")).filter(F.col("embedding").isNotNull() & (F.length("request_id") % 2 == 0))
    return asked, active, waiting


@registered(folds.REFERENCE)
def j11_find_reference(v: Views) -> DataFrame:
    asked, active, waiting = asked_in_frames(v)
    return lookup.find_reference(asked, v.gallery, v.face_gallery, active, active, waiting).select("request_id", "global_id", "track_id", rounded("score"), "method")


@registered("WITH t AS (SELECT * FROM tracks WHERE frame_idx % 4 <> 1 AND (camera_id + tracker_id) % 4 <> 0), l AS (SELECT camera_id, max(frame_idx) AS frame_idx FROM t GROUP BY 1) SELECT camera_id, frame_idx, tracker_id, tracker_id * 3 % 7 AS global_id FROM t JOIN l USING (camera_id, frame_idx)")
def t6_active_tracks(v: Views) -> DataFrame:
    """Every fourth frame has no tracks and leaves the snapshot as it was."""
    seen = assign.known_gid(v.tracks, track_map(v)).filter("global_id IS NOT NULL")
    one = F.when(F.col("frame_idx") % 4 != 1, F.struct("tracker_id", "global_id"))
    last = active_tracks(seen.groupBy(*CAM).agg(F.collect_list(one).alias("tracks")))
    return last.select(*CAM, F.explode("tracks").alias("t")).select(*CAM, "t.*")


@registered("SELECT camera_id, CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) AS VARCHAR) AS day, count(*) AS n_detections, count(*) FILTER ((camera_id + tracker_id) % 4 <> 0) AS n_identified, round(avg(obs_id % 50 / 2.0), 5) AS mean_ms FROM tracks GROUP BY 1, 2")
def t10_window_metrics(v: Views) -> DataFrame:
    seen = assign.known_gid(v.tracks, track_map(v)).withColumns({"ts": F.col("ts").cast("timestamp"), "ms": F.col("obs_id") % 50 / 2.0})
    out = metrics_stream(seen, "1 day", None, timings=["ms"])
    return out.select("camera_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n_detections", "n_identified", rounded("mean_ms"))


@registered("""
    WITH r AS (SELECT k.crop_a, g.global_id, g.entry_seq, CASE WHEN k.crop_a % 13 = 5 THEN 1.0 ELSE count(*) / 1024.0 END AS rate FROM kp_matches k JOIN gallery g ON g.entry_seq % 17 = k.crop_b GROUP BY 1, 2, 3)
    SELECT crop_a, global_id, max(rate) AS max_rate FROM r GROUP BY 1, 2
""")
def a5_max_match_rate(v: Views) -> DataFrame:
    """The highest rate of a crop with the entries of each identity, of which each stands for one of 17 crops."""
    pairs = v.kp_matches.select("crop_a", "crop_b").distinct().withColumn("empty", F.col("crop_a") % 13 == 5)
    entries = v.gallery.select("camera_id", "global_id", "entry_seq", (F.col("entry_seq") % 17).alias("crop_b"))
    rates = gallery.match_rate(v.kp_matches, pairs).join(entries.select("crop_b", "entry_seq"), "crop_b")
    return gallery.max_match_rate(rates, entries, "crop_a").select("crop_a", "global_id", "max_rate")


@registered("""
    WITH c AS (SELECT obs_id, tracker_id AS global_id, CAST(obs_id % 3 AS INT) AS q, obs_id % 97 AS c FROM tracks),
    x AS (SELECT c.obs_id, c.q, max(CASE WHEN (c.c + g.entry_seq) % 5 <> 0 THEN (c.c * 7 + g.entry_seq) % 60 / 100.0 END) AS max_rate, max(g.pose_quality) AS best, count(g.entry_seq) AS n FROM c LEFT JOIN gallery g ON g.global_id = c.global_id GROUP BY 1, 2)
    SELECT obs_id, max_rate, q >= 1 AND (n = 0 OR coalesce(max_rate < 0.4, false) OR q > best) AS added FROM x
""")
def p14_novel_view_by_rate(v: Views) -> DataFrame:
    """Novelty by the match rates of key points in place of cosines; a candidate shows one of 97 crops."""
    e = F.array(F.lit(1.0))
    c = v.tracks.select("obs_id", F.lit(0).cast("long").alias("camera_id"), F.col("tracker_id").alias("global_id"), (F.col("obs_id") % 3).cast("int").alias("pose_quality"), (F.col("obs_id") % 97).alias("crop"), e.alias("embedding"))
    rates = c.select("crop").distinct().crossJoin(v.gallery.select("entry_seq")).filter((F.col("crop") + F.col("entry_seq")) % 5 != 0)
    rates = rates.withColumn("match_rate", (F.col("crop") * 7 + F.col("entry_seq")) % 60 / 100.0)
    return gallery.novel_view(c, v.gallery, "obs_id", rates=rates, crop="crop").select("obs_id", "max_rate", "added")


def recording(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations of the three cameras with bodies and faces, and galleries that each camera has."""
    body = v.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("body"))
    seen = v.det.join(body, "vec_id").withColumns({"qualifies": F.col("det_seq") % 7 != 0, "has_face": F.col("det_seq") % 28 == 0, "pose_quality": (F.col("det_seq") % 2 + 1).cast("int")})
    seen = seen.withColumn("face", F.when(F.col("det_seq") % 4 == 0, F.slice("body", 1, 32)))
    everywhere = lambda g: g.withColumn("camera_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return seen, everywhere(v.gallery), everywhere(v.face_gallery)


@registered(folds.RECORDING.format(runs=RUNS_SQL.strip()))
def t4_identify_tracks(v: Views) -> DataFrame:
    """Every track of the three cameras against one gallery, which each camera has."""
    done = batch.identify_tracks(*recording(v), params=Params(sim_threshold=0.3, face_match_strategy="face_body_all_gallery"))
    return done.select("camera_id", "tracker_id", "frame_idx", "global_id", rounded("match_score"), "match_type")


@registered(folds.RECORDING_BY_FACE.format(runs=RUNS_SQL.strip()))
def t4_identify_by_face(v: Views) -> DataFrame:
    """As t4_identify_tracks; a row with a face that doesn't qualify decides its track by the face alone."""
    done = batch.identify_tracks(*recording(v), params=Params(sim_threshold=0.3, face_match_strategy="face_body_all_gallery"), by_face=True)
    return done.select("camera_id", "tracker_id", "frame_idx", "global_id", rounded("match_score"), "match_type")


@registered()
def t4_identify_recording(v: Views) -> DataFrame:
    """Tracks of a recording after the merge of new identities, with how many entries their identities' galleries have."""
    done = batch.identify_recording(*recording(v), params=Params(sim_threshold=0.3, face_match_strategy="face_body_all_gallery"))
    count = lambda g, name: g.groupBy("camera_id", "global_id").agg(F.count(F.lit(1)).alias(name))
    both = done.tracks.join(count(done.bodies, "n_bodies"), ["camera_id", "global_id"], "left").join(count(done.faces, "n_faces"), ["camera_id", "global_id"], "left")
    return both.select("camera_id", "tracker_id", "frame_idx", "global_id", rounded("match_score"), "match_type", "is_new", "n_bodies", "n_faces")


@registered(folds.DUPLICATES.format(centroids=CENTROID_SQL.format("split_gallery")))
def t5_merge_identities(v: Views) -> DataFrame:
    """The split gallery with near-duplicate identities in one."""
    g = v.split_gallery
    state = g.groupBy("camera_id", "global_id").agg(F.max("entry_seq").alias("last_seen")).withColumns({e: F.lit(0.0) for e in boxes.EDGES})
    done = batch.merge_identities(g, v.face_gallery, track_map(v), state)
    return done.bodies.select("global_id", "entry_seq")


@registered(folds.POSE_REUSE.format(boxes=W1_SQL))
def a12_pose_reuse(v: Views) -> DataFrame:
    """Frames whose tracks are all known and still keep their qualities."""
    seen = v.tracks.withColumn("pose_quality", F.when(F.col("obs_id") % 5 == 0, F.col("obs_id") % 3))
    known = v.tracks.select("camera_id", "tracker_id").distinct().filter("tracker_id % 4 <> 0").withColumns({"global_id": F.col("tracker_id"), "since": F.lit(20).cast("long")})
    return batch.frames_for_pose(seen, known, Params(stable_min_frames=1)).select("obs_id", "cached_quality", "needs_pose")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: perturbed queries are matched to the gallery, and counted by identity."""
    found = QUERIES["j6_match_top1"](spark, sf_dir)
    return found.groupBy("global_id").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("score"), 5).alias("mean_score"))


__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
