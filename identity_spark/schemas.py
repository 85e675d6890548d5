"""Schemas of messages and tables, as DDL; none is inferred."""

TRACK_MESSAGE = "stamp DOUBLE, frame_idx BIGINT, frame_h INT, frame_w INT, frame_jpeg_b64 STRING, tracks ARRAY<STRUCT<tracker_id: BIGINT, bbox: ARRAY<INT>, confidence: DOUBLE>>"
IDENTITY_MESSAGE = "stamp DOUBLE, frame_idx BIGINT, tracks ARRAY<STRUCT<tracker_id: BIGINT, global_id: BIGINT, bbox: ARRAY<INT>, confidence: DOUBLE, match_score: DOUBLE, match_type: STRING>>"
FIND_REQUEST = "request_id STRING, image_jpeg_b64 STRING"
FIND_RESULT = "request_id STRING, global_id BIGINT, track_id BIGINT, score DOUBLE, method STRING"
BODY_ENTRY = "camera_id BIGINT, global_id BIGINT, entry_seq BIGINT, frame_idx BIGINT, embedding ARRAY<DOUBLE>, pose_quality INT, has_face BOOLEAN"
FACE_ENTRY = "camera_id BIGINT, global_id BIGINT, entry_seq BIGINT, frame_idx BIGINT, embedding ARRAY<DOUBLE>"
IDENTITIES = "camera_id BIGINT, frame_idx BIGINT, tracker_id BIGINT, global_id BIGINT, match_score DOUBLE, match_type STRING, face_sim DOUBLE, stable_count BIGINT"
