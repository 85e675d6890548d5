"""Connected components of a table of links, by large stars and small stars.

Each step hangs neighbours onto the smallest node seen, as joins and partial minima; the links are written between
steps. A hub with very many links is one key of a join, which Spark can split, and of a minimum, which is made before
the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Large: a node's larger neighbours go to its least one; small: its smaller ones do."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another one; the root is its component's least node."""
    now = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") > F.col("b")).distinct(), "links")
    before = None
    while True:
        now = written(_step(written(_step(now, True), "links"), False), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
