"""Tables replayed as streams, in parts by event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint_folder

Streams = dict[str, DataFrame]


def replayed(tables: dict[str, DataFrame], make: Callable[[Streams], DataFrame], ts: dict[str, str], cuts: int = 2, mode: str = "append", closing: dict[str, DataFrame] | None = None) -> tuple[DataFrame, str]:
    """What the stream ``make(streams)`` gave for the tables, and the folder of its checkpoint.

    Each part of the tables is written behind those before, and the stream goes on over it; ts names each table's time.
    closing: rows that come last of all, to let the watermark pass; ``make`` or the caller leaves them out."""
    spark = next(iter(tables.values())).sparkSession
    root = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
    spans = [df.agg(F.min(ts[n]).alias("a"), F.max(ts[n]).alias("b")).first() for n, df in tables.items()]
    low, high = min(s["a"] for s in spans), max(s["b"] for s in spans)
    edges = [low + (high - low) * k / cuts for k in range(cuts)]
    parts = [{n: df.filter((F.col(ts[n]) >= a) & (F.col(ts[n]) < b if b is not None else F.lit(True))) for n, df in tables.items()} for a, b in zip(edges, [*edges[1:], None], strict=True)]
    for part in parts + ([closing] if closing else []):
        for n, df in part.items():
            df.write.mode("append").parquet(f"{root}/in/{n}")
        out = make({n: spark.readStream.schema(df.schema).parquet(f"{root}/in/{n}") for n, df in tables.items()})
        query = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out"), f"{root}/state"
