"""How long the stages of a stream take, as the stream itself tells.

A stage leaves its milliseconds in a column (``took`` of :func:`identity_spark.operators.infer.run_model`), which is summed
as the rows pass, with no shuffle and no second look at them. A listener gathers these sums from each batch's progress,
with the times that Spark tells of the batch, and gives them as a table."""

from __future__ import annotations

import json
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "stage_times"
TIMES = "query string, batch long, at timestamp, stage string, n_rows long, ms double"


def observed(rows: DataFrame, stages: dict[str, str], name: str = OBSERVED) -> DataFrame:
    """``rows``, of a stream or a table; stages: name -> column with the stage's milliseconds, null where it did nothing."""
    sums = [x for s, c in stages.items() for x in (F.count(c).alias(f"n_{s}"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"ms_{s}"))]
    return rows.observe(name, F.count(F.lit(1)).alias("n"), *sums)


class StageTimes(StreamingQueryListener):
    """Rows of TIMES from the progress of all streams of a session while it is attached (``spark.streams.addListener``).

    Stages of :func:`observed` come with their rows; "batch" is all of a batch, "planning", "commits" and "sources" its
    parts outside the rows' way. They are held until :meth:`save` or :meth:`table` takes them: some rows a batch."""

    PARTS = {"triggerExecution": "batch", "queryPlanning": "planning", "walCommit": "commits", "commitOffsets": "commits", "latestOffset": "sources", "getBatch": "sources"}

    def __init__(self, name: str = OBSERVED):
        self.name, self.held, self.lock = name, [], Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        taken: dict[str, list] = {}
        for key, stage in self.PARTS.items():
            if key in p.durationMs:
                entry = taken.setdefault(stage, [p.numInputRows, 0.0])
                entry[1] += float(p.durationMs[key])
        if self.name in p.observedMetrics:
            seen = p.observedMetrics[self.name].asDict()
            taken |= {c[3:]: [seen[f"n_{c[3:]}"], float(seen[c])] for c in seen if c.startswith("ms_")}
        with self.lock:
            self.held += [json.dumps([p.name or str(p.id), p.batchId, p.timestamp, stage, n, ms]) for stage, (n, ms) in taken.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        """What came since the last time."""
        with self.lock:
            rows, self.held = [json.loads(x) for x in self.held], []
        text = spark.createDataFrame(rows, TIMES.replace("at timestamp", "at string"))
        return text.withColumn("at", F.to_timestamp("at"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends it to a table."""
        self.table(spark).write.mode("append").parquet(path)


def stage_windows(times: DataFrame, width: str = "30 seconds") -> DataFrame:
    """stage, window, n_batches, n_rows, ms and ms_a_row: the times of all batches that began in a window."""
    found = times.groupBy("query", "stage", F.window("at", width)).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows"), F.sum("ms").alias("ms"))
    return found.select("query", "stage", "window", "n_batches", "n_rows", "ms", (F.col("ms") / F.nullif("n_rows", F.lit(0))).alias("ms_a_row"))
