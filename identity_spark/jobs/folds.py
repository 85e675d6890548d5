"""SQL for the queries that fold rows in order, as recursive queries with the fold's state in a list."""

from __future__ import annotations

from .fixtures import overlap_sql

_FACES = """
    a AS (SELECT *, anchor_idx % (640 // stride) * stride AS ax, anchor_idx // (640 // stride) * stride AS ay, sqrt(1 / (1 + exp(-cls)) * (1 / (1 + exp(-obj)))) AS score FROM raw_faces),
    d AS (SELECT frame_idx, event_id, score, ax + bbox[1] * stride AS cx, ay + bbox[2] * stride AS cy, exp(bbox[3]) * stride AS w, exp(bbox[4]) * stride AS h FROM a WHERE score >= 0.65),
    n AS (SELECT frame_idx, event_id, score, {'x1': cx - w / 2, 'y1': cy - h / 2, 'x2': cx + w / 2, 'y2': cy + h / 2} AS b, row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, event_id) AS k FROM d)
"""

#: A face stays if no face that stayed before it overlaps it more than the threshold.
NMS = f"""
    WITH RECURSIVE {_FACES},
    r(frame_idx, k, kept, ids) AS (
      SELECT frame_idx, 1, [b], [event_id] FROM n WHERE k = 1
      UNION ALL SELECT r.frame_idx, r.k + 1, CASE WHEN t.stays THEN list_append(r.kept, t.b) ELSE r.kept END, CASE WHEN t.stays THEN list_append(r.ids, t.event_id) ELSE r.ids END
      FROM (SELECT n.frame_idx, n.k, n.b, n.event_id, len(list_filter(s.kept, lambda o: {overlap_sql("o.", "n.b.")} > 0.3)) = 0 AS stays FROM r s JOIN n ON n.frame_idx = s.frame_idx AND n.k = s.k + 1) t
      JOIN r ON r.frame_idx = t.frame_idx AND r.k + 1 = t.k),
    last AS (SELECT frame_idx, arg_max(ids, k) AS ids FROM r GROUP BY 1)
    SELECT n.frame_idx, n.event_id, round(n.score, 5) AS score FROM n JOIN last USING (frame_idx) WHERE list_contains(last.ids, n.event_id)
"""

#: Completions of a frame in the order of their best score; each takes its best identity that none took before.
GREEDY = """
    WITH RECURSIVE s AS (SELECT q.query_id, g.global_id, max(list_cosine_similarity(q.body, g.embedding)) AS score, min(g.entry_seq) AS first_seq FROM queries q, gallery g GROUP BY 1, 2),
    c AS (SELECT query_id, query_id % 40 AS frame_idx, (SELECT max(score) FROM s WHERE s.query_id = q.query_id AND s.score >= 0.1) AS prescore FROM queries q),
    p AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY coalesce(prescore, 0.0) DESC, query_id) AS place FROM c),
    o AS (SELECT p.frame_idx, p.place, p.query_id, (SELECT list({'g': s.global_id, 's': s.score} ORDER BY s.score DESC, s.first_seq) FROM s WHERE s.query_id = p.query_id AND s.score >= 0.1) AS options FROM p),
    r(frame_idx, place, taken, query_id, pick) AS (
      SELECT frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS STRUCT(g BIGINT, s DOUBLE)) FROM (SELECT DISTINCT frame_idx FROM o)
      UNION ALL SELECT frame_idx, place, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.g) END, query_id, pick
      FROM (SELECT o.frame_idx, o.place, r.taken, o.query_id, list_filter(coalesce(o.options, []), lambda x: NOT list_contains(r.taken, x.g))[1] AS pick FROM r JOIN o ON o.frame_idx = r.frame_idx AND o.place = r.place + 1) t)
    SELECT frame_idx, query_id AS tracker_id, pick.g AS global_id, round(pick.s, 5) AS match_score FROM r WHERE place > 0
"""

#: Entries of a target and its sources; while there are more than ten the most central one goes.
MERGED = """
    WITH RECURSIVE m AS (SELECT CASE WHEN global_id IN (1, 3, 7) THEN global_id - 1 ELSE global_id END AS target, * FROM gallery),
    e AS (SELECT target, list(entry_seq ORDER BY target <> global_id, entry_seq) AS ids, list(embedding ORDER BY target <> global_id, entry_seq) AS vs FROM m WHERE target IN (0, 2, 6) GROUP BY 1),
    r(target, ids, vs) AS (
      SELECT * FROM e
      UNION ALL SELECT target, list_concat(ids[1:k - 1], ids[k + 1:]), list_concat(vs[1:k - 1], vs[k + 1:])
      FROM (SELECT target, ids, vs, list_position(alike, list_max(alike)) AS k FROM (
        SELECT r.target, r.ids, r.vs, list_transform(r.vs, lambda v: list_sum(list_transform(r.vs, lambda w: list_dot_product(v, w)))) AS alike FROM r WHERE len(r.ids) > 10) x) y),
    left_over AS (SELECT target, unnest(ids) AS entry_seq FROM r WHERE len(ids) <= 10)
    SELECT CAST(0 AS BIGINT) AS camera_id, m.target AS global_id, m.entry_seq, m.frame_idx FROM m LEFT JOIN left_over l ON l.target = m.target AND l.entry_seq = m.entry_seq WHERE m.target NOT IN (0, 2, 6) OR l.entry_seq IS NOT NULL
"""

#: Key frames of an identity in order: one enters if it is novel or shows more of the body, then the cap holds.
BODY = """
    WITH RECURSIVE o AS (SELECT *, obs_id % 2 = 0 AS has_face, row_number() OVER (PARTITION BY camera_id, global_id ORDER BY frame_idx, obs_id) AS k FROM body_candidates WHERE pose_quality >= 1),
    r(camera_id, global_id, k, entries) AS (
      SELECT DISTINCT camera_id, global_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(seq BIGINT, f BIGINT, q INT, v DOUBLE[])[]) FROM o
      UNION ALL SELECT camera_id, global_id, k, CASE WHEN len(entries) <= 10 THEN entries ELSE list_concat(entries[1:out - 1], entries[out + 1:]) END
      FROM (SELECT *, list_position(alike, list_max(alike)) AS out FROM (
        SELECT camera_id, global_id, k, entries, list_transform(entries, lambda v: list_sum(list_transform(entries, lambda w: list_dot_product(v.v, w.v)))) AS alike FROM (
          SELECT o.camera_id, o.global_id, o.k, CASE
            WHEN len(r.entries) = 0 OR list_max(list_transform(r.entries, lambda x: list_cosine_similarity(x.v, o.embedding))) < 0.85 OR o.pose_quality > list_max(list_transform(r.entries, lambda x: x.q))
            THEN list_append(r.entries, {'seq': o.obs_id, 'f': o.frame_idx, 'q': o.pose_quality, 'v': o.embedding}) ELSE r.entries END AS entries
          FROM r JOIN o ON o.camera_id = r.camera_id AND o.global_id = r.global_id AND o.k = r.k + 1) x) y) z),
    final AS (SELECT camera_id, global_id, unnest(arg_max(entries, k)) AS e FROM r GROUP BY 1, 2)
    SELECT camera_id, global_id, e.seq AS entry_seq, e.f AS frame_idx, e.q AS pose_quality FROM final
"""

#: Faces of an identity in order: one that is too like another is left out, and the most central one makes room.
FACE = """
    WITH RECURSIVE o AS (SELECT camera_id, global_id, frame_idx, obs_id, CAST(embedding[1:32] AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY camera_id, global_id ORDER BY frame_idx, obs_id) AS k FROM body_candidates),
    r(camera_id, global_id, k, vs, obs_id, sim, added) AS (
      SELECT DISTINCT camera_id, global_id, CAST(0 AS BIGINT), CAST([] AS DOUBLE[][]), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false FROM o
      UNION ALL SELECT camera_id, global_id, k, CASE WHEN NOT fresh THEN vs WHEN len(vs) < 10 THEN list_append(vs, v) ELSE list_append(list_concat(vs[1:out - 1], vs[out + 1:]), v) END, obs_id, sim, fresh
      FROM (SELECT *, sim < 0.95 AS fresh, list_position(alike, list_max(alike)) AS out FROM (
        SELECT o.camera_id, o.global_id, o.k, o.obs_id, o.v, r.vs, coalesce(list_max(list_transform(r.vs, lambda x: list_cosine_similarity(x, o.v))), -1.0) AS sim,
          list_transform(r.vs, lambda x: list_sum(list_transform(r.vs, lambda w: list_dot_product(x, w)))) AS alike
        FROM r JOIN o ON o.camera_id = r.camera_id AND o.global_id = r.global_id AND o.k = r.k + 1) x) y)
    SELECT camera_id, global_id, obs_id AS face_seq, added, round(sim, 5) AS face_sim FROM r WHERE k > 0
"""

#: Requests against both galleries, then against known and waiting tracks.
REFERENCE = """
    WITH a AS (SELECT r.request_id || '@' || CAST(r.camera_id AS VARCHAR) AS request_id, CASE WHEN q.query_id % 9 <> 0 THEN q.body END AS body, q.face FROM requests r JOIN queries q USING (query_id)),
    f AS (SELECT a.request_id, g.global_id, max(list_cosine_similarity(a.face, g.embedding)) AS f FROM a, face_gallery g WHERE a.body IS NOT NULL AND a.face IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT a.request_id, g.global_id, max(list_cosine_similarity(a.body, g.embedding)) AS b FROM a, gallery g WHERE a.body IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT request_id, global_id, (coalesce(f, 0.0) + coalesce(b, 0.0)) / ((f IS NOT NULL)::INT + (b IS NOT NULL)::INT) AS score FROM f FULL JOIN b USING (request_id, global_id)),
    hits AS (SELECT request_id, arg_min(global_id, (-score, global_id)) AS global_id, max(score) AS score FROM s GROUP BY 1 HAVING max(score) >= 0.82),
    tracks_of AS (SELECT unnest(range(6)) AS tracker_id),
    missed AS (SELECT a.* FROM a WHERE request_id NOT IN (SELECT request_id FROM hits)),
    kb AS (SELECT m.request_id, t.tracker_id, max(list_cosine_similarity(m.body, g.embedding)) AS b FROM missed m, tracks_of t JOIN gallery g ON g.global_id = t.tracker_id % 4 WHERE m.body IS NOT NULL GROUP BY 1, 2),
    kf AS (SELECT m.request_id, t.tracker_id, max(list_cosine_similarity(m.face, g.embedding)) AS f FROM missed m, tracks_of t JOIN face_gallery g ON g.global_id = t.tracker_id % 4 WHERE m.face IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT kb.request_id, kb.tracker_id, CASE WHEN f IS NULL THEN b ELSE (b + f) / 2 END AS score, 0 AS kind FROM kb LEFT JOIN kf USING (request_id, tracker_id)
      UNION ALL SELECT request_id, 77, list_cosine_similarity(body, body), 1 FROM missed WHERE body IS NOT NULL AND length(request_id) % 2 = 0),
    best AS (SELECT request_id, arg_max(tracker_id, (round(score, 9), -kind, -tracker_id)) AS track_id, max(score) AS score FROM d GROUP BY 1)
    SELECT request_id, global_id, CASE WHEN global_id < 2 THEN global_id + 4 WHEN global_id < 4 THEN global_id ELSE -1 END AS track_id, round(score, 5) AS score, CASE WHEN global_id < 4 THEN 'track_gid' ELSE 'gid_only' END AS method FROM hits
    UNION ALL SELECT m.request_id, -1, CASE WHEN m.body IS NULL THEN -1 ELSE best.track_id END, round(CASE WHEN m.body IS NULL THEN 0.0 ELSE best.score END, 5), CASE WHEN m.body IS NULL THEN 'none' ELSE 'direct' END FROM missed m LEFT JOIN best USING (request_id)
"""

#: Tracks of the recording: runs, confirmation, means, scores with faces, one-to-one by frame, new numbers. {runs}: the runs.
RECORDING = """
    WITH RECURSIVE {runs},
    e AS (SELECT camera_id, tracker_id, arg_min(run, frame_idx) AS run, min(frame_idx) AS frame_idx FROM k WHERE seen >= 5 AND face = 0 AND done = 0 GROUP BY 1, 2),
    own AS (SELECT e.camera_id, e.tracker_id, e.frame_idx, k.frame_idx AS f, k.obs_id, b.embedding FROM e JOIN k USING (camera_id, tracker_id, run) JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.qualifies AND k.frame_idx <= e.frame_idx),
    x AS (SELECT camera_id, tracker_id, frame_idx, unnest(range(1, 65)) AS d, unnest(embedding) AS y FROM own),
    m AS (SELECT camera_id, tracker_id, frame_idx, d, avg(CAST(y AS DOUBLE)) AS y FROM x GROUP BY ALL),
    v AS (SELECT camera_id, tracker_id, frame_idx, list(y ORDER BY d) AS body FROM m GROUP BY ALL),
    lf AS (SELECT camera_id, tracker_id, arg_max(CAST(embedding[1:32] AS DOUBLE[]), f) AS face FROM own WHERE obs_id % 4 = 0 GROUP BY 1, 2),
    q AS (SELECT v.*, lf.face, t.obs_id AS det_seq FROM v LEFT JOIN lf USING (camera_id, tracker_id) JOIN tracks t USING (camera_id, tracker_id, frame_idx)),
    fs AS (SELECT q.camera_id, q.tracker_id, g.global_id, max(list_cosine_similarity(q.face, g.embedding)) AS f FROM q, face_gallery g WHERE q.face IS NOT NULL GROUP BY ALL),
    bs AS (SELECT q.camera_id, q.tracker_id, g.global_id, max(list_cosine_similarity(q.body, g.embedding)) AS b, min(g.entry_seq) AS first_seq FROM q, gallery g GROUP BY ALL),
    s AS (SELECT camera_id, tracker_id, global_id, (coalesce(f, 0.0) + coalesce(b, 0.0)) / ((f IS NOT NULL)::INT + (b IS NOT NULL)::INT) AS score, first_seq FROM fs FULL JOIN bs USING (camera_id, tracker_id, global_id)),
    o AS (SELECT q.camera_id, q.frame_idx, q.tracker_id, q.face IS NOT NULL AS has_face, row_number() OVER (PARTITION BY q.camera_id, q.frame_idx ORDER BY coalesce(p.best, 0.0) DESC, q.det_seq) AS place, p.options
      FROM q LEFT JOIN (SELECT s.camera_id, s.tracker_id, max(score) AS best, list({{'g': global_id, 's': score}} ORDER BY score DESC, CASE WHEN q.face IS NULL THEN first_seq ELSE global_id END) AS options
        FROM s JOIN q USING (camera_id, tracker_id) WHERE score >= 0.3 GROUP BY 1, 2) p ON p.camera_id = q.camera_id AND p.tracker_id = q.tracker_id),
    picks(camera_id, frame_idx, place, taken, tracker_id, has_face, pick) AS (
      SELECT camera_id, frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), false, CAST(NULL AS STRUCT(g BIGINT, s DOUBLE)) FROM (SELECT DISTINCT camera_id, frame_idx FROM o)
      UNION ALL SELECT camera_id, frame_idx, place, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.g) END, tracker_id, has_face, pick
      FROM (SELECT o.camera_id, o.frame_idx, o.place, z.taken, o.tracker_id, o.has_face, list_filter(coalesce(o.options, []), lambda w: NOT list_contains(z.taken, w.g))[1] AS pick FROM picks z JOIN o ON o.camera_id = z.camera_id AND o.frame_idx = z.frame_idx AND o.place = z.place + 1) t)
    SELECT camera_id, tracker_id, frame_idx, CASE WHEN pick IS NULL THEN 9 + row_number() OVER (PARTITION BY camera_id, pick IS NULL ORDER BY frame_idx, place) ELSE pick.g END AS global_id,
      round(coalesce(pick.s, 0.0), 5) AS match_score, CASE WHEN pick IS NULL THEN 'NEW' WHEN has_face THEN 'F+B' ELSE 'B' END AS match_type FROM picks WHERE place > 0
"""

#: Identities of the split gallery go over into older ones; then each target's entries are capped.
DUPLICATES = """
    WITH RECURSIVE {centroids},
    edges AS (SELECT a.global_id AS source, arg_max(b.global_id, list_cosine_similarity(a.e, b.e)) AS target FROM c a JOIN c b ON b.global_id < a.global_id GROUP BY 1 HAVING max(list_cosine_similarity(a.e, b.e)) >= 0.9),
    up(source, target) AS (SELECT source, target FROM edges UNION ALL SELECT up.source, e.target FROM up JOIN edges e ON e.source = up.target),
    roots AS (SELECT source, min(target) AS target FROM up GROUP BY 1),
    g AS (SELECT s.*, coalesce(r.target, s.global_id) AS target FROM split_gallery s LEFT JOIN roots r ON r.source = s.global_id),
    touched AS (SELECT DISTINCT target FROM roots),
    e AS (SELECT target, list(entry_seq ORDER BY target <> global_id, entry_seq) AS ids, list(embedding ORDER BY target <> global_id, entry_seq) AS vs FROM g WHERE target IN (SELECT target FROM touched) GROUP BY 1),
    r(target, ids, vs) AS (
      SELECT * FROM e
      UNION ALL SELECT target, list_concat(ids[1:k - 1], ids[k + 1:]), list_concat(vs[1:k - 1], vs[k + 1:])
      FROM (SELECT target, ids, vs, list_position(alike, list_max(alike)) AS k FROM (
        SELECT r.target, r.ids, r.vs, list_transform(r.vs, lambda v: list_sum(list_transform(r.vs, lambda w: list_dot_product(v, w)))) AS alike FROM r WHERE len(r.ids) > 10) x) y)
    SELECT target AS global_id, unnest(ids) AS entry_seq FROM r WHERE len(ids) <= 10
    UNION ALL SELECT target, entry_seq FROM g WHERE target NOT IN (SELECT target FROM touched)
"""

#: Whether a frame needs its poses: a track that isn't known, wasn't still for long enough, or has no quality so far. {boxes}: boxes before.
POSE_REUSE = """
    WITH {boxes}, s AS (SELECT *, coalesce(tracker_id % 4 <> 0 AND frame_idx > 20 AND prev_iou >= 0.7, false) AS still FROM i),
    g AS (SELECT *, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx) AS island,
      last_value(CASE WHEN obs_id % 5 = 0 THEN obs_id % 3 END IGNORE NULLS) OVER (PARTITION BY camera_id, tracker_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached_quality FROM s),
    n AS (SELECT *, sum(still::INT) OVER (PARTITION BY camera_id, tracker_id, island ORDER BY frame_idx) AS stable_count FROM g)
    SELECT obs_id, cached_quality, bool_or(NOT (tracker_id % 4 <> 0 AND frame_idx > 20) OR stable_count < 1 OR cached_quality IS NULL) OVER (PARTITION BY camera_id, frame_idx) AS needs_pose FROM n
"""

#: As RECORDING, with decisions by face alone: rows that don't qualify but have a face end a wait, and go first in a frame.
_CHANGES = {
    "e AS (SELECT camera_id, tracker_id, arg_min(run, frame_idx) AS run, min(frame_idx) AS frame_idx FROM k WHERE seen >= 5 AND face = 0 AND done = 0 GROUP BY 1, 2),": """ends AS (SELECT camera_id, tracker_id, run, frame_idx, face = 1 AS by_face FROM k WHERE done = 0 AND (face = 1) <> (seen >= 5)),
    e AS (SELECT camera_id, tracker_id, arg_min(run, frame_idx) AS run, min(frame_idx) AS frame_idx, arg_min(by_face, frame_idx) AS by_face FROM ends GROUP BY 1, 2),""",
    "WHERE k.qualifies AND k.frame_idx <= e.frame_idx)": "WHERE k.qualifies AND k.frame_idx <= e.frame_idx AND NOT e.by_face)",
    "q AS (SELECT v.*, lf.face, t.obs_id AS det_seq FROM v LEFT JOIN lf USING (camera_id, tracker_id) JOIN tracks t USING (camera_id, tracker_id, frame_idx)),": """q AS (SELECT v.*, lf.face, t.obs_id AS det_seq, false AS by_face FROM v LEFT JOIN lf USING (camera_id, tracker_id) JOIN tracks t USING (camera_id, tracker_id, frame_idx)
      UNION ALL SELECT e.camera_id, e.tracker_id, e.frame_idx, NULL, CAST(b.embedding[1:32] AS DOUBLE[]), t.obs_id, true FROM e JOIN tracks t USING (camera_id, tracker_id, frame_idx) JOIN embeddings b USING (vec_id) WHERE e.by_face),""",
    "FROM q, gallery g GROUP BY ALL)": "FROM q, gallery g WHERE q.body IS NOT NULL GROUP BY ALL)",
    "q.face IS NOT NULL AS has_face, row_number() OVER (PARTITION BY q.camera_id, q.frame_idx ORDER BY coalesce(p.best, 0.0) DESC, q.det_seq)": "CASE WHEN q.by_face THEN 'F' WHEN q.face IS NOT NULL THEN 'F+B' ELSE 'B' END AS has_face, row_number() OVER (PARTITION BY q.camera_id, q.frame_idx ORDER BY q.by_face DESC, CASE WHEN q.by_face THEN 0.0 ELSE coalesce(p.best, 0.0) END DESC, q.det_seq)",
    "WHERE score >= 0.3 GROUP BY 1, 2": "WHERE score >= CASE WHEN q.by_face THEN 0.35 ELSE 0.3 END GROUP BY 1, 2",
    "CAST(NULL AS BIGINT), false, CAST(NULL AS STRUCT": "CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS STRUCT",
    "WHEN has_face THEN 'F+B' ELSE 'B' END AS match_type": "ELSE has_face END AS match_type",
}
RECORDING_BY_FACE = RECORDING
for _old, _new in _CHANGES.items():
    RECORDING_BY_FACE = RECORDING_BY_FACE.replace(_old, _new)
