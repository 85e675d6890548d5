"""Reproducible shuffle and shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of (key, text checksum, size), nulls first. The permutation sends row number
``i`` of ``n`` to another number in ``[0, n)``; the shard is that number modulo the shard count and the slot is the
quotient. So shard sizes differ by one at most (law ``rows``), slots are gapless, and :func:`place` finds the shard
and slot of any row number without a look at the data.

Defined results: a null text has size 8 and the checksum of no bytes; a null key sorts first; rows that are equal
in key, checksum and size are interchangeable; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

PRIME = (1 << 31) - 1
ROUNDS = 6


def domain(n: int, most: int = 100_000) -> tuple[int, int]:
    """Halves (a, b) with a * b >= n, near the square root, of the least excess among ``most`` values of a."""
    root = max(1, isqrt(n))
    low = max(1, min(2, root), root // 2, root - most)
    a = min(range(root, low - 1, -1), key=lambda x: -n % x)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and addend of each half round."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        y = (x * 69621 + 7) % PRIME
        keys.append((x | 1, y))
        x = y
    return keys


def place(i: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of row number ``i`` of ``n``: the driver's side of :func:`shard_documents`."""
    a, b = domain(n)
    while True:
        left, right = divmod(i, b)
        for k, (m, c) in enumerate(round_keys(seed)):
            if k % 2 == 0:
                t = (right * m + c) % PRIME
                left = (left + t * t % PRIME) % a
            else:
                t = (left * m + c) % PRIME
                right = (right + t * t % PRIME) % b
        i = left * b + right
        if i < n:
            return i % n_shards, i // n_shards


def _permuted(df: DataFrame, column: str, a: int, b: int, seed: int, when: Column | None) -> DataFrame:
    """One pass of the permutation of ``[0, a * b)`` over ``column``; where ``when`` is false it stays.

    Each half round is a projection of its own, so that no expression is repeated in generated code."""
    df = df.withColumns({"_l": F.expr(f"{column} div {b}"), "_r": F.col(column) % b})
    for k, (m, c) in enumerate(round_keys(seed)):
        source, target, size = ("_r", "_l", a) if k % 2 == 0 else ("_l", "_r", b)
        df = df.withColumn("_t", (F.col(source) * F.lit(m).cast("long") + F.lit(c).cast("long")) % PRIME)
        df = df.withColumn(target, (F.col(target) + F.col("_t") * F.col("_t") % PRIME) % size)
    moved = F.col("_l") * F.lit(b).cast("long") + F.col("_r")
    return df.withColumn(column, moved if when is None else F.when(when, moved).otherwise(F.col(column))).drop("_l", "_r", "_t")


def numbered(df: DataFrame, order: list[str], column: str, name: str) -> tuple[DataFrame, int]:
    """Global row numbers in ``column`` by the order of ``order``, and the number of rows.

    Rows are dealt by range and sorted, numbered inside each partition and written; the counts of the partitions
    (one small row each) give the offsets. No task sees more than its range."""
    n_parts = partitions(df)
    dealt = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    kept = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    kept = kept.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # one row of two numbers for each partition: its size is bounded by the number of partitions
    out = kept.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before"), kept.count()


def shard_documents(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 20_240_601) -> DataFrame:
    """key, size, text_crc32, row_number, law, shard, slot and grown_shard of every row of ``docs``."""
    words = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("_key"), (F.octet_length(words).cast("long") + 8).alias("size"), F.crc32(words.cast("binary")).alias("text_crc32")
    )
    rows, n = numbered(narrow, ["_key", "text_crc32", "size"], "row_number", "numbered")
    a, b = domain(n)
    rows = _permuted(rows.withColumn("_p", F.col("row_number")), "_p", a, b, seed, None)
    for _ in range(a * b - n):  # a walk meets each of the numbers beyond n once at most
        rows = _permuted(rows, "_p", a, b, seed, F.col("_p") >= n)
    return rows.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.expr(f"_p div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
