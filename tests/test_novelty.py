"""Novelty of views against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from identity_spark.operators import gallery


def test_candidates_of_one_crop_go_by_its_rates(spark):
    rows = [(k, k % 2, k % 4, k % 3, k % 5) for k in range(60)]
    candidates = spark.createDataFrame(rows, "obs_id long, camera_id long, global_id long, pose_quality int, crop long").withColumn("embedding", F.array(F.lit(1.0)))
    entries = [(c, g, 10 * c + g + 4 * n, 1) for c in (0, 1) for g in (0, 1, 2) for n in range(2)]
    rate = {(crop, e[2]): (crop * 7 + e[2] * 5) % 11 / 10 for crop in range(5) for e in entries if (crop + e[2]) % 4}
    rates = spark.createDataFrame([(*k, r) for k, r in rate.items()], "crop long, entry_seq long, match_rate double")
    held = spark.createDataFrame(entries, "camera_id long, global_id long, entry_seq long, pose_quality int")
    want = {}
    for obs, camera, gid, quality, crop in rows:
        own = [e for e in entries if e[:2] == (camera, gid)]
        best = max((rate[crop, e[2]] for e in own if (crop, e[2]) in rate), default=None)
        want[obs] = (best, quality >= 1 and (not own or (best is not None and best < 0.4) or quality > 1))
    by_crop = gallery.novel_view(candidates, held, "obs_id", rates=rates, crop="crop")
    by_key = gallery.novel_view(candidates, held, "obs_id", rates=candidates.select("obs_id", "crop").join(rates, "crop").drop("crop"))
    for out in (by_crop, by_key):
        assert {r["obs_id"]: (r["max_rate"], r["added"]) for r in out.collect()} == want
    assert {x[1] for x in want.values()} == {True, False} and None in {x[0] for x in want.values()}


def test_candidates_meet_their_identity_in_blocks(spark):
    """No join has a row for each candidate and entry: cosines come from products of packed blocks."""
    vector = lambda k: [float((k * 7 + d * 3) % 11 - 5) for d in range(6)]
    rows = [(k, 0, k % 4, k % 3, None if k % 13 == 0 else vector(k)) for k in range(80)]
    entries = [(0, g, 10 * g + n, 1, vector(50 * g + n)) for g in (0, 1, 2) for n in range(9)]
    candidates = spark.createDataFrame(rows, "obs_id long, camera_id long, global_id long, pose_quality int, embedding array<double>")
    held = spark.createDataFrame(entries, "camera_id long, global_id long, entry_seq long, pose_quality int, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {}
    for obs, _, gid, quality, v in rows:
        own = [e[4] for e in entries if e[1] == gid]
        best = max((cos(v, e) for e in own), default=None) if v else None
        want[obs] = (None if best is None else round(best, 9), bool(v) and quality >= 1 and (not own or best < 0.85 or quality > 1))
    out = gallery.novel_view(candidates, held, "obs_id")
    assert {r["obs_id"]: (None if r["max_sim"] is None else round(r["max_sim"], 9), r["added"]) for r in out.collect()} == want
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
