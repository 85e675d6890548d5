"""Recorded files: any ranges give the same records, in batch and stream."""

from __future__ import annotations

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from identity_spark.sources import messages, recorded


def pictures(n, seed):
    r = random.Random(seed)
    body = lambda: bytes(r.choices([0, 1, 10, 13, 0xD8, 0xD9, 0x41], k=r.choice([0, 1, 5, 300])))
    # a picture may hold another one (its preview) whose end isn't followed by a picture
    return [recorded.FIRST + body() + (recorded.FIRST + b"preview" + recorded.LAST + b"x" if k % 7 == 3 else b"") + body() + recorded.LAST for k in range(n)]


def ranges(data, step, kind, finished=True):
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    end = recorded.whole_end(file, len(data), kind, finished)
    return [r for a in range(0, end, step) for r in recorded.records(file, a, min(a + step, end), end, kind)]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000, 10**9])
@pytest.mark.parametrize("chunk", [32, 1 << 20])
def test_any_ranges_give_the_same_records(monkeypatch, step, chunk):
    monkeypatch.setattr(recorded, "READ_BYTES", chunk)
    frames = pictures(40, 1)
    data = b"".join(f + (b"\r\n" if k % 3 == 0 else b"") for k, f in enumerate(frames))
    found = ranges(data, step, "frames")
    assert [f for _, f in found] == frames and all(data[o : o + len(f)] == f for o, f in found)
    assert [f for _, f in ranges(data + recorded.FIRST + b"cut off", step, "frames")] == frames
    lines = [b"", b"a", b"b" * 500, "é".encode(), b""] * 5 + [b"end"]
    text = b"\n".join(lines)
    assert [x for _, x in ranges(text, step, "lines")] == lines
    assert [x for _, x in ranges(text, step, "lines", finished=False)] == lines[:-1]
    assert ranges(b"", step, "frames") == ranges(b"", step, "lines") == []


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_frames_of_cameras(spark, tmp_path, split):
    made = [(c, k, f) for c in (1, 2, 5) for k, f in enumerate(pictures(60, c))]
    df = spark.createDataFrame(made, "camera_id long, frame_idx long, frame binary").repartition(7)
    path = str(tmp_path / "rec")
    assert sorted((r["camera_id"], r["n_frames"]) for r in recorded.write_recording(df, path).collect()) == [(1, 60), (2, 60), (5, 60)]
    read = recorded.numbered_frames(recorded.read_recorded(spark, path, split_bytes=split))
    got = sorted((int(r["path"].split("camera=")[1].split(".")[0]), r["frame_idx"], bytes(r["frame"])) for r in read.collect())
    assert got == sorted(made)
    assert recorded.read_recorded(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        recorded.read_recorded(spark, path, kind="odd").collect()


def test_a_log_that_grows(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log = tmp_path / "log" / "a.jsonl"
    message = lambda k: f'{{"stamp": {k}.5, "frame_idx": {k}, "frame_h": 10, "frame_w": 20, "tracks": [{{"tracker_id": {k}, "bbox": [0, 0, 5, 5], "confidence": 0.5}}]}}\n'.encode()
    done = b""
    for upto in (b"".join(map(message, range(5))) + message(5)[:30], b"".join(map(message, range(12))), b"".join(map(message, range(12)))):
        log.write_bytes(upto)
        stream = recorded.read_recorded(spark, str(tmp_path / "log"), "lines", stream=True, split_bytes=100)
        rows = messages.read_track_messages(stream, keep=["offset"])
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        done = upto
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["frame_idx"], done[r["offset"] : r["offset"] + 8]) for r in out.collect()) == [(k, b'{"stamp"') for k in range(12)]
    assert out.agg(F.count_distinct("offset")).first()[0] == 12
