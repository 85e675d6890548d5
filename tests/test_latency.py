"""Stage times of a real stream."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from identity_spark.operators import infer
from identity_spark.streaming import latency


def slow(ms):
    def make():
        def run(xs):
            time.sleep(ms * len(xs) / 1000)
            return [[float(len(x))] for x in xs]

        return run

    return make


def test_a_stream_tells_its_stages_times(spark, tmp_path):
    rows = spark.range(60).select("id", F.when(F.col("id") % 4 != 0, F.lit(b"abc")).alias("crop"))
    for k in range(3):
        rows.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    times = latency.StageTimes()
    spark.streams.addListener(times)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = infer.embed_table(stream, {"m": slow(4)}, "m", out="body", took="ms_body")
        made = infer.embed_table(made, {"m": slow(1)}, "m", out="face", took="ms_face")
        made = latency.observed(made, {"body": "ms_body", "face": "ms_face"})
        q = made.writeStream.queryName("timed").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        for _ in range(100):  # progress comes to listeners behind the stream
            if sum('"body"' in x for x in times.held) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(times)
    times.save(spark, str(tmp_path / "times"))
    assert times.table(spark).count() == 0
    told = spark.read.parquet(str(tmp_path / "times"))
    whole = {r["stage"]: r for r in latency.stage_windows(told, "1 hour").groupBy("stage").agg(F.sum("n_batches").alias("b"), F.sum("n_rows").alias("n"), F.sum("ms").alias("ms")).collect()}
    assert {"body", "face", "batch", "planning", "commits"} <= set(whole)
    assert whole["body"]["n"] == whole["face"]["n"] == whole["batch"]["n"] == 60 and whole["body"]["b"] == 3
    assert 4 * 45 <= whole["body"]["ms"] and 45 <= whole["face"]["ms"] < whole["body"]["ms"] < whole["batch"]["ms"]
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 60 and abs(kept.agg(F.sum("ms_body")).first()[0] - whole["body"]["ms"]) < 1e-6
