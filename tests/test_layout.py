"""Tracks stored by track: the same rows, and no shuffle of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from identity_spark.jobs import layout
from identity_spark.jobs.fixtures import Views
from identity_spark.operators import assign, pose, tracklets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    seen = Views(spark, SF).tracks.withColumns({"qualifies": F.col("obs_id") % 7 != 0, "has_face": F.col("obs_id") % 28 == 0, "pose_quality": F.when(F.col("obs_id") % 5 == 0, F.col("obs_id") % 3), "face": F.col("obs_id")})
    known = seen.select("camera_id", "tracker_id").distinct().filter("tracker_id % 4 <> 0").withColumns({"global_id": F.col("tracker_id") * 3, "match_score": F.lit(0.9), "match_type": F.lit("B")})
    root = tmp_path_factory.mktemp("layout")
    yield seen, known, layout.write_by_track(layout.numbered(seen), "tracks_here", f"file://{root}/tracks", 4), layout.write_by_track(known, "map_here", f"file://{root}/map", 4)
    for name in ("tracks_here", "map_here"):
        layout.drop(spark, name)


WORK = {
    "moved": lambda t, m: tracklets.prev_bbox_iou(t).select("obs_id", "prev_iou"),
    "stable": lambda t, m: tracklets.stable_count(tracklets.prev_bbox_iou(t).withColumn("known_before", F.col("frame_idx") > 9)).select("obs_id", "stable_count"),
    "runs": lambda t, m: tracklets.latest_face(tracklets.confirm_points(tracklets.pending_runs(t)), "face").select("obs_id", "run", "seen", "confirms", "face_ends_wait", "latest_face"),
    "quality": lambda t, m: pose.last_known_quality(t).select("obs_id", "cached_quality"),
    "known": lambda t, m: assign.known_gid(t, m).select("obs_id", "global_id"),
    "enriched": lambda t, m: assign.enrich_tracks(t, m).select("obs_id", "global_id", "match_score", "match_type"),
}


@pytest.mark.parametrize("name", WORK)
def test_work_by_track_stays_in_its_buckets(spark, stored, name):
    seen, known, table, table_map = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, want = WORK[name](table, table_map), WORK[name](seen, known)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(made) == rows(want)
        assert layout.exchanges(made) == [] and layout.exchanges(want) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
