"""Centroid clustering by Yinyang grouping: exact rounds of assignment and update, with most distances left out.

Centroids are put into a few groups once. A vector keeps its centroid, an upper bound of its distance to it, and for each
group a lower bound of the distance to the group's other centroids. When centroids move, bounds are loosened by how far.
A vector whose upper bound is below all lower bounds stays (the global filter); else its own distance is computed, and
only groups whose bound isn't above it are looked at, centroid by centroid.

Vectors are packed into blocks as they are read, and a block carries its bounds from round to round in a written table,
so no round shuffles vectors: what is added up over all blocks are sums and counts of the vectors that changed, k rows
of them. Distances are squared and whole; bounds are their roots with a margin for rounding.

Components are ``floor(scale * x)``. Centroids start as the vectors of the least SHA-256 of ``seed:id``.

Defined results: vectors that are null, of another length, or hold a null or a non-finite component take no part; a null
id is assigned as any other, and starts a centroid only where others are too few; rows of one id are as many vectors, in
the order of their components among the starts; equal starts are several centroids of which the first takes all, so the
others stay as they are; fewer vectors than k give as many centroids; ties go to the smaller number; an empty table gives
no rows; further columns are ignored. A component of 2**26 and more raises an error, as a distance might pass 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, written
from .topk import usable

#: Of components, so that a distance of 64 of them fits a 64-bit number.
MOST = 1 << 26
#: Below it products of vectors are exact in doubles.
EXACT = 1 << 22
MARGIN = 1e-9
BLOCK = "ids array<long>, v binary, near binary, upper binary, lower binary, moved binary, looked long"
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Centroids:
    """Whole components, the group of each centroid, and how many vectors and what sum it had in the last round."""

    c: np.ndarray
    group: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    @property
    def groups(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(int(self.group.max()) + 1)]

    def moved(self, change: np.ndarray) -> Centroids:
        """After a round: change has a count and sums for each centroid, of vectors that came less those that went."""
        n, sums = self.n + change[:, 0], self.sums + change[:, 1:]
        return Centroids(np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], self.c), self.group, n, sums)


def grouped(c: np.ndarray, groups: int) -> np.ndarray:
    """A group for each centroid: a few rounds of means over the centroids, from evenly spaced ones."""
    at = c[np.linspace(0, len(c) - 1, min(groups, len(c))).astype(int)].astype(float)
    for _ in range(5):
        own = ((c[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        at = np.stack([c[own == g].mean(axis=0) if (own == g).any() else at[g] for g in range(len(at))])
    return np.unique(own, return_inverse=True)[1]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all of c."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 + MARGIN)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 - MARGIN)


def first_bounds(v: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper bound, and lower bound of each group."""
    d = squared(v, now.c)
    near = d.argmin(axis=1)
    row = np.arange(len(v))
    upper = _above(d[row, near])
    root = _below(d)
    root[row, near] = np.inf
    return near, upper, np.stack([root[:, g].min(axis=1) for g in now.groups], axis=1)


def next_bounds(v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: Centroids, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As :func:`first_bounds`, from the bounds of the round before; and how many distances were computed."""
    drift = _above(((now.c - before.c) ** 2).sum(axis=1))
    groups = now.groups
    far = np.array([drift[g].max() for g in groups])
    near, upper = near.copy(), upper + drift[near]
    lower = lower - far - MARGIN * (np.where(np.isfinite(lower), lower, 0) + far)
    rows = np.flatnonzero(upper >= lower.min(axis=1))
    looked = len(rows)
    d = np.empty(len(rows), np.int64)
    for k in np.unique(near[rows]).tolist():
        own = near[rows] == k
        d[own] = squared(v[rows[own]], now.c[k : k + 1])[:, 0]
    upper[rows] = _above(d)
    keep = upper[rows] >= lower[rows].min(axis=1)
    rows, d = rows[keep], d[keep]
    for g, members in enumerate(groups):
        at = np.flatnonzero(lower[rows, g] <= upper[rows])
        if not len(at):
            continue
        r = rows[at]
        to = squared(v[r], now.c[members])
        looked += to.size
        best = to.argmin(axis=1)
        nearest, number = to[np.arange(len(r)), best], members[best]
        old, old_d = near[r].copy(), d[at].copy()
        better = (nearest < old_d) | (nearest == old_d) & (number < old)
        near[r] = np.where(better, number, old)
        d[at] = np.where(better, nearest, old_d)
        root = _below(to)
        root[members[None, :] == near[r][:, None]] = np.inf
        lower[r, g] = root.min(axis=1)
        # the centroid that a vector leaves is one of its group's others now
        left = np.flatnonzero(better & (number != old))
        home = now.group[old[left]]
        lower[r[left], home] = np.minimum(lower[r[left], home], _below(old_d[left]))
        upper[r] = _above(d[at])
    return near, upper, lower, looked


def _change(v: np.ndarray, k: int, after: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Counts and sums by centroid of vectors that came, less those that went."""
    out = np.zeros((k, v.shape[1] + 1), np.int64)
    rows = np.arange(len(v)) if before is None else np.flatnonzero(after != before)
    for to, sign in ((after, 1), (before, -1)):
        if to is not None:
            for c in np.unique(to[rows]).tolist():
                own = rows[to[rows] == c]
                out[c, 0] += sign * len(own)
                out[c, 1:] += sign * v[own].sum(axis=0)
    return out


def _block(ids: pa.Array, v: bytes, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, looked: int) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    parts = [v, near.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), moved.astype("<i8").tobytes()]
    return pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in parts), pa.array([looked])], ["ids", "v", "near", "upper", "lower", "moved", "looked"])


def _packed(rows: DataFrame, scale: int, now: Centroids) -> DataFrame:
    """Blocks of the vectors of ``rows`` (id, v) with their first bounds."""
    dim = now.c.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False) * scale)
                if np.abs(flat).max() >= MOST:
                    raise ValueError("components are too large for exact 64-bit distances")
                v = flat.astype(np.int64).reshape(-1, dim)
                near, upper, lower = first_bounds(v, now)
                yield _block(batch.column("id"), v.astype("<i4").tobytes(), near, upper, lower, _change(v, len(now.c), near, None), v.shape[0] * len(now.c))

    return rows.mapInArrow(tidy(pack), BLOCK)


def _opened(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        raw = batch.column("v")[i].as_buffer()
        near = np.frombuffer(batch.column("near")[i].as_buffer(), "<i4").astype(np.int64)
        upper, lower = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8") for c in ("upper", "lower"))
        yield batch.column("ids")[i].values, raw.to_pybytes(), np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, dim), near, upper, lower.reshape(len(near), -1)


def _stepped(blocks: DataFrame, before: Centroids, now: Centroids) -> DataFrame:
    dim = now.c.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, v, near, upper, lower in _opened(batch, dim):
                after, upper, lower, looked = next_bounds(v, near, upper, lower, before, now)
                yield _block(ids, raw, after, upper, lower, _change(v, len(now.c), after, near), looked)

    return blocks.mapInArrow(tidy(step), BLOCK)


def _moved(blocks: DataFrame, k: int, dim: int) -> np.ndarray:
    """Changes of all blocks, added up in each task and then by Spark: k * (dim + 1) numbers."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * (dim + 1), np.int64)
        for batch in batches:
            for x in batch.column("moved"):
                out += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    out = np.zeros(k * (dim + 1), np.int64)
    for r in blocks.select("moved").mapInArrow(tidy(total), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(k, dim + 1)


def _distances(blocks: DataFrame, now: Centroids) -> DataFrame:
    """id, cluster and distance of every vector."""
    dim = now.c.shape[1]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, v, near, _, _ in _opened(batch, dim):
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(((v - now.c[near]) ** 2).sum(axis=1))], ["id", "cluster", "distance"])

    return blocks.mapInArrow(tidy(own), "id long, cluster int, distance long")


def starts(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The first centroids; what comes to the driver are k rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.floor(np.array([r["v"] for r in first]) * scale).astype(np.int64)


def digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, groups: int = 4, scale: int = 64, seed: int = 1) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector after ``rounds`` rounds.

    groups: of centroids; more of them prune better and cost a number for each vector."""
    spark: SparkSession = vectors.sparkSession
    rows = vectors.filter(usable(vector) & (F.size(vector) == dim)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = starts(rows, k, scale, seed)
    if not len(first):
        return spark.createDataFrame([], f"{id} long, {RESULT}")
    now = Centroids(first, grouped(first, groups), np.zeros(len(first), np.int64), np.zeros(first.shape, np.int64))
    blocks = written(_packed(rows, scale, now), "vectors")
    for _ in range(rounds):
        before, now = now, now.moved(_moved(blocks, len(first), dim))
        blocks = written(_stepped(blocks, before, now), "vectors")
    found = written(_distances(blocks, now), "distances")
    # k rows
    of = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    table = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in of), digest(now.c[r["cluster"]])) for r in of], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id), *[x.split()[0] for x in RESULT.split(", ")])
