"""Exact top-k search by distributed histogram selection.

Every query is scored against every row in blocks; the scores are never kept. A pass gives each query a histogram of
its scores over a range, added up over all blocks, and narrows the range to the bin that holds the k-th highest score;
after a few passes that bin is one value wide. The last pass keeps the scores at or above that value, and ties go to
the smaller id.

Groups of query blocks meet groups of row blocks in tiles. There are a few tiles for each core, however large the tables
and however many the partitions of a shuffle are; a tile holds its queries, of a bounded size, and lets rows stream past.

Scores are integer inner products of ``floor(1024 * x)``. Defined results: vectors that are null, or hold a null or a
non-finite component, take no part; a pair of vectors of different lengths has no score; empty vectors score 0 among
themselves; of rows with the same id each takes part, and a query doesn't meet rows of its own id; fewer than k
candidates give fewer rows; ties have the smaller id first; rows with a null id take no part; further columns are
ignored; an empty table gives no rows. A score is a 64-bit number: where the largest components of a block of rows and of
one of queries are such that a product could pass 2**62, the operator raises an error rather than give a wrong one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

SCALE = 1024
QUERY_BLOCK = 1024
ROW_BLOCK = 1024
BINS = 2048
#: Tiles for each core.
TILES = 4
#: Bytes that a tile's queries, with what it keeps of them, take at most; a block of queries is not parted.
HELD = 64 << 20
LEAST = np.iinfo(np.int64).min


def usable(vector: str) -> Column:
    """True where the vector and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def packed(rows: DataFrame, block: int, salt: int) -> DataFrame:
    """Rows (id, v array<long>) packed by length into blocks of about ``block`` rows: dim, part, ids and components.

    The block of a row comes from a hash of its place in the table, so rows that are equal in all columns, which may be a
    third of it, are dealt out as any others; the number of blocks follows the table."""
    n = max(1, rows.count())
    blocks = -(-n // block)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(blocks))
    return (
        rows.withColumns({"dim": F.size("v"), "part": part})
        .groupBy("dim", "part")
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        .select("dim", "part", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))
    )


def _matrix(flat: pa.ListScalar, dim: int) -> np.ndarray:
    return flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def _scores(q: np.ndarray, x: np.ndarray, dim: int, n_q: int, n_x: int, q_most: float, x_most: float) -> np.ndarray:
    """Exact: below 2**53 every partial sum of a float64 product is an integer that float64 holds.

    q_most, x_most: the largest magnitudes of components."""
    if not dim:
        return np.zeros((n_q, n_x), np.int64)
    bound = q_most * x_most * dim
    if bound < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if bound >= 2.0**62:
        raise ValueError("components are too large for exact 64-bit scores")
    return q.astype(np.int64) @ x.astype(np.int64).T


def _each(batches: Iterator[pa.RecordBatch], begin: Callable[[SimpleNamespace], None], meet: Callable[[SimpleNamespace, np.ndarray, np.ndarray], None], end: Callable[[SimpleNamespace], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``end`` gives for each block of queries of a tile, after ``meet(block, row ids, scores)`` for all rows of the tile.

    A pair of the same id has the least score there is. A block has ids, and low and high of its queries' ranges."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            at = {name: batch.column(name)[i] for name in batch.schema.names}
            dim = at["dim"].as_py()
            ids = at["ids"].values.to_numpy(zero_copy_only=False)
            v = _matrix(at["flat"], dim)
            most = np.abs(v).max(initial=0)
            if (tile := (dim, at["q_group"].as_py(), at["x_group"].as_py())) != now:
                yield from map(end, held)
                now, held = tile, []
            if at["side"].as_py() == 0:
                block = SimpleNamespace(ids=ids, v=v, most=most)
                if "bounds" in at:
                    _set_bounds(block, at["bounds"].values)
                begin(block)
                held.append(block)
                continue
            for q in held:
                s = _scores(q.v, v, dim, len(q.ids), len(ids), q.most, most)
                own = np.flatnonzero(np.isin(ids, q.ids))
                a, b = np.nonzero(q.ids[:, None] == ids[own])
                s[a, own[b]] = LEAST
                meet(q, ids, s)
    yield from map(end, held)


def _set_bounds(block: SimpleNamespace, bounds: pa.StructArray) -> None:
    """low and high for each query of a block; a query without candidates has a range that is empty."""
    of, low, high = (bounds.field(n).to_numpy(zero_copy_only=False) for n in ("query_id", "low", "high"))
    order = np.argsort(of)
    place = np.minimum(np.searchsorted(of, block.ids, sorter=order), len(of) - 1)
    known = of[order[place]] == block.ids
    block.low = np.where(known, low[order[place]], np.iinfo(np.int64).max)
    block.high = np.where(known, high[order[place]], LEAST)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Of sorted numbers, the place where each one's run begins."""
    first = np.r_[True, rows[1:] != rows[:-1]][: len(rows)]
    return np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))


def _highest(top: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A row's highest scores so far, the least first, with those of ``s``."""
    k = top.shape[1]
    i, j = np.nonzero(s > top[:, :1])
    if len(i) > 4 * top.size:
        return np.partition(np.c_[top, s], s.shape[1], axis=1)[:, s.shape[1] :]
    if not len(i):
        return top
    rows, scores = np.r_[np.repeat(np.arange(len(top)), k), i], np.r_[top.ravel(), s[i, j]]
    order = np.lexsort((scores, rows))
    ends = np.cumsum(np.bincount(rows, minlength=len(top)))
    return scores[order[ends[:, None] - np.arange(k, 0, -1)]]


def _ranges(tiles: DataFrame) -> DataFrame:
    """Least and highest score and number of candidates of each query."""

    def begin(q):
        q.least, q.highest, q.n = np.full(len(q.ids), np.iinfo(np.int64).max), np.full(len(q.ids), LEAST), np.zeros(len(q.ids), np.int64)

    def meet(q, _, s):
        own = s == LEAST
        q.highest = np.maximum(q.highest, s.max(axis=1, initial=LEAST))
        q.n += (~own).sum(axis=1)
        q.least = np.minimum(q.least, np.where(own, np.iinfo(np.int64).max, s).min(axis=1, initial=np.iinfo(np.int64).max))

    def end(q):
        keep = q.n > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q.ids, q.least, q.highest, q.n)], ["query_id", "low", "high", "n"])

    found = tiles.mapInArrow(tidy(lambda batches: _each(batches, begin, meet, end)), "query_id long, low long, high long, n long")
    return found.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _bounded(tiles: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """The range of each query's k-th highest score, narrowed to one of BINS bins of the range before.

    Of each tile only its highest bins count, down to the k-th score there: the k-th score of all is no lower."""
    most = BINS

    def begin(q):
        q.top = np.full((len(q.ids), k), LEAST)

    def meet(q, _, s):
        q.top = _highest(q.top, np.where((s >= q.low[:, None]) & (s <= q.high[:, None]), s, LEAST))

    def end(q):
        i, j = np.nonzero(q.top > LEAST)
        bins = (q.top[i, j] - q.low[i]) // ((q.high[i] - q.low[i]) // most + 1)
        order = np.lexsort((bins, i))
        i, bins = i[order], bins[order]
        start = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(bins) != 0)][: len(i)])
        return pa.RecordBatch.from_arrays([pa.array(q.ids[i[start]]), pa.array(bins[start]), pa.array(np.diff(np.r_[start, len(i)]))], ["query_id", "bin", "n"])

    counted = tiles.mapInArrow(tidy(lambda batches: _each(batches, begin, meet, end)), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    reached = counted.join(ranges, "query_id").withColumn("sum", F.col("above") + F.sum("n").over(down)).filter(F.col("sum") >= F.least(F.lit(k), F.col("total")))
    first = reached.groupBy("query_id").agg(F.max_by(F.struct("bin", "n", "sum", "low", "high", "total"), "bin").alias("x")).select("query_id", "x.*")
    width = F.expr(f"(high - low) div {most} + 1")  # whole numbers, as in the tiles: a double would be off beyond 2**53
    start = F.col("low") + F.col("bin") * width
    return first.select("query_id", start.alias("low"), F.least(start + width - 1, F.col("high")).alias("high"), (F.col("sum") - F.col("n")).alias("above"), "total")


def _blocks(df: DataFrame) -> tuple[int, int]:
    """Number of blocks, and bytes of their components and ids."""
    sizes = df.select((F.size("ids").cast("long") * (F.col("dim") + 1) * 8).alias("b")).agg(F.count("b"), F.sum("b")).first()
    return sizes[0], sizes[1] or 0


def dealt(q: DataFrame, x: DataFrame, k: int) -> tuple[int, int]:
    """Groups of query blocks and of row blocks, whose pairs are the tiles.

    A block of one side is sent to all groups of the other, so the tables' sizes balance them; the groups of queries are
    as many as their memory asks for, at least."""
    (n_q, q_bytes), (n_x, x_bytes) = _blocks(q), _blocks(x)
    tiles = max(1, min(TILES * q.sparkSession.sparkContext.defaultParallelism, n_q * n_x))
    kept = q.select(F.size("ids").cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    fits = -(-(q_bytes + 8 * (k + 4) * kept) // HELD)
    q_groups = max(1, min(n_q, max(fits, round((tiles * q_bytes / max(x_bytes, 1)) ** 0.5))))
    return q_groups, max(1, min(n_x, tiles // q_groups))


def tiled(x: DataFrame, q: DataFrame, groups: tuple[int, int], ranges: DataFrame | None = None) -> DataFrame:
    """Blocks of both sides by tile, in partitions where a tile's queries (side 0) come before its rows (side 1).

    groups: of query blocks and of row blocks. ranges: of the queries, sent along."""
    q_groups, x_groups = groups
    if ranges is not None:
        of_block = q.select("dim", "part", F.explode(F.array_distinct("ids")).alias("query_id")).join(ranges, "query_id")
        bounds = of_block.groupBy("dim", "part").agg(F.collect_list(F.struct("query_id", "low", "high")).alias("bounds"))
        q = q.join(bounds.hint("merge"), ["dim", "part"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("part", F.lit(n)).cast("int")
    # queries are repeated after they are dealt out, as a small table is read by one task
    q = q.repartition(q_groups * x_groups, "dim", "part").withColumns({"q_group": own(q_groups), "side": F.lit(0)}).withColumn("x_group", each(x_groups))
    x = x.withColumns({"x_group": own(x_groups), "side": F.lit(1)}).withColumn("q_group", each(q_groups))
    tile = ["dim", "q_group", "x_group"]
    return q.unionByName(x, allowMissingColumns=True).repartition(q_groups * x_groups, *tile).sortWithinPartitions(*tile, "side")


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and score of the k highest scores of each query; both inputs have (id long, v array)."""
    whole = lambda df: df.filter(usable("v") & F.col("id").isNotNull()).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    q = written(packed(whole(queries), QUERY_BLOCK, 1), "queries")
    x = written(packed(whole(rows), ROW_BLOCK, 2), "rows")
    groups = dealt(q, x, k)
    found = _ranges(tiled(x, q, groups)).select("query_id", "low", "high", F.lit(0).cast("long").alias("above"), F.col("n").alias("total"))
    ranges = written(found, "ranges")
    while ranges.filter(F.col("high") > F.col("low")).limit(1).count():
        ranges = written(_bounded(tiled(x, q, groups, ranges), ranges, k), "ranges")

    def begin(q):
        q.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(q, x_ids, s):
        i, j = np.nonzero((s >= q.low[:, None]) & (s > LEAST))
        if len(i):
            i, ids, scores = (np.r_[a, b] for a, b in zip(q.found, (i, x_ids[j], s[i, j]), strict=True))
            order = np.lexsort((ids, -scores, i))
            order = order[np.arange(len(i)) - _starts(i[order]) < k]  # of many ties, a tile keeps those that can win
            q.found = i[order], ids[order], scores[order]

    def end(q):
        i, ids, scores = q.found
        return pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    found = tiled(x, q, groups, ranges).mapInArrow(tidy(lambda batches: _each(batches, begin, meet, end)), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
