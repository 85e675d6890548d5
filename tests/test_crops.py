"""The crop store: versions, pruning by camera, and changes that fail."""

from __future__ import annotations

import pytest

from identity_spark.sources import crops as store


def made(spark, cameras, frames):
    rows = [(c, g, f, "body", f"crops/gid{g:04d}_f{f:07d}.jpg", bytes([c, g, f])) for c in cameras for g in range(3) for f in frames]
    return spark.createDataFrame(rows + [(cameras[0], 9, 9, "body", "", b""), (cameras[0], 9, 9, "body", "", None)], "camera_id long, global_id long, frame_idx long, kind string, crop_path string, crop binary")


def rows(df):
    return sorted((r["camera_id"], r["global_id"], r["frame_idx"], bytes(r["crop"])) for r in df.collect())


def test_versions_of_a_store(spark, tmp_path, monkeypatch):
    s = store.CropStore(spark, str(tmp_path / "crops"))
    assert s.version == 0 and s.read().count() == 0 and s.prune(made(spark, [1], [1])) == 0
    assert s.add(made(spark, [1, 2], range(5))) == 1 and s.add(made(spark, [2, 3], range(5, 8))) == 2
    first = rows(s.read())
    assert len(first) == 2 * 3 * 5 + 2 * 3 * 3 and rows(s.read(1)) == [r for r in first if r[0] in (1, 2) and r[2] < 5]

    gallery = s.read().filter("camera_id <> 2 OR frame_idx % 2 = 0").select("camera_id", "crop_path").cache()
    left = [r for r in first if r[0] != 2 or r[2] % 2 == 0]
    with monkeypatch.context() as m:  # it fails after the new parts are written
        m.setattr(store.CropStore, "_commit", lambda self, listed: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            s.prune(gallery)
    assert s.version == 2 and rows(s.read()) == first and s.unlisted(1).count() == 1

    assert s.prune(gallery) == 3 and rows(s.read()) == left
    assert s.prune(gallery) == 3 and rows(s.read()) == left
    untouched = s.versions.filter("camera_id IN (1, 3) AND version >= 2").select("camera_id", "part").distinct()
    assert untouched.count() == 2  # their parts are the ones they had
    assert s.prune(gallery.filter("camera_id = 5")) == 4 and s.read().count() == 0
    assert rows(s.read(2)) == first
    assert s.add(made(spark, [7], [1])) == 5 and len(rows(s.read())) == 3
    assert {r["camera_id"] for r in s.unlisted(5).collect()} == {1, 2, 3}
