"""Lookup requests and their responses, met in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlate_stream(requests: DataFrame, responses: DataFrame, wait: str = "10 minutes", delay: str = "1 minute", sent: str = "ts", arrived: str = "arrived") -> DataFrame:
    """Requests with the response that arrived last within ``wait`` of being sent; nulls where none did.

    As :func:`identity_spark.operators.lookup.correlate_lookup` for streams: requests with request_id and a time ``sent``,
    responses with request_id and a time ``arrived``, both watermarked by ``delay``. A request comes out once no response
    can come any more, with all columns it has, those of the response after them. Responses before the request, beyond
    ``wait`` or behind the watermark are dropped, and the state of a request goes with its row. Two requests of one
    request_id are two rows. Output mode "append"."""
    names = [c for c in responses.columns if c not in ("request_id", arrived)]
    asked = requests.withWatermark(sent, delay)
    came = responses.select(F.col("request_id").alias("_id"), F.col(arrived).alias("_at"), F.struct(*names).alias("_r")).withWatermark("_at", delay)
    in_time = (F.col("request_id") == F.col("_id")) & (F.col("_at") >= F.col(sent)) & (F.col("_at") <= F.col(sent) + F.expr(f"INTERVAL {wait}"))
    # a number has no watermark, so that the requests' one is the only one beyond the join
    pairs = asked.join(came, in_time, "left_outer").select(*requests.columns, "_r", F.unix_micros("_at").alias("_at"))
    last = pairs.groupBy(*requests.columns).agg(F.max_by("_r", "_at").alias("_r"))
    return last.select(*requests.columns, "_r.*")
