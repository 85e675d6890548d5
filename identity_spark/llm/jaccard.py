"""Exact join of texts by the Jaccard similarity of their word shingles, in size-banded tiles with bitmap signatures.

1. Each text becomes the set of its shingle hashes, kept as size, digest and a hashed bitmap. Equal sets are one node.
2. Two sets that are similar enough share a shingle in the prefix of either, in whichever order all sets are sorted;
   rare shingles come first, by a fixed-size count sketch of the whole corpus, which only bears on speed. A tile is the
   sets of one band of sizes that share a prefix shingle; a set whose partners can be larger than its band is a guest
   in the next band.
3. In each tile the set that stands in most tiles, often the least edited of a group of near copies, is held against
   every other one. Bit counts bound the overlap from above, and what may
   reach the threshold is verified by an exact intersection of sorted arrays. Links merge sets into groups.
4. What is left are tiles of three sets or more from at least two groups. All pairs across groups are held against
   each other there, by bitmaps and then exactly. Large tiles are cut into pairs of blocks, so no task holds one whole,
   and the tile's largest group meets the other ones only. A pair that shares many tiles is told by the tiles that
   each of its sets was in before: it comes from the first of them, not from each.

A pair of sets inside one group needs no look, as its link changes nothing; every other linked pair is looked at in
step 3 or 4. So the components are exact, and the work of a group of near copies grows with its size.

A set is named by a 64-bit digest, and where two sets have one name, which a second digest tells, all but one of them
by another. Shingles are 64-bit hashes (see :mod:`words`), so the sets are exact but for two different shingles of one
hash.

Defined results: a null text has no words; texts without words have no shingles and no links; a text with fewer words
than a shingle is one shingle; equal texts and equal sets are linked; rows with equal or null keys are rows of their
own, the component's name is its least key that isn't null; a text of any length is taken whole, in memory of some 30
bytes for each of its own; which of two equal rows is which doesn't matter; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_prefix, partitions, tidy, written
from .components import components
from .words import mix, pieces, shingle_sets

#: A band holds sizes from 4**k to 4**(k + 1) - 1, and its bitmaps have a bit for each of the largest size, in low bands four.
BAND = 4
#: Counters of the sketch, and how many of them travel in one row.
SKETCH = 1 << 22
SKETCH_CHUNK = 1 << 15
_SHIFT = np.uint64(64 - 22)
#: A tile of more sets is cut into blocks of half as many.
TILE = 1024
#: Partners by which a set of a larger tile is tried in step 3; step 4 sees to the rest.
FIRST_TRIES = 3
#: Beyond this many rows (40 bytes each) a list of keys or sets is joined by a shuffle and not broadcast.
BROADCAST_ROWS = 100_000
#: Far above what 64-bit digests of any number of sets give.
MOST_RENAMED = 1000
#: Sets that a task remembers to have posted; an exact copy of one isn't posted again.
POSTED = 100_000
#: Tiles before a row's own by which a pair that came before is known.
BEFORE = 8
_PAIRS = 1 << 15


def band_of(n: np.ndarray) -> np.ndarray:
    """Exact for every size: the number of quarterings."""
    return np.searchsorted(BAND ** np.arange(1, 31, dtype=np.int64), n, "right")


def width_of(band: int) -> int:
    """Bytes of a bitmap."""
    return max(32, BAND ** (int(band) + 1) // (2 if band < 4 else 8))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def bitmap(s: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width * 8, np.uint8)
    bits[(s & np.uint64(width * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(m: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as they would be with fewer bits."""
    return m if m.shape[1] == width else np.bitwise_or.reduce(m.reshape(len(m), -1, width), axis=1)


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of bitmaps and sizes: those whose overlap, as the bits bound it, reaches the threshold."""
    width = min(x.shape[1], y.shape[1])
    a, b = folded(x, width).view(np.uint64), folded(y, width).view(np.uint64)
    only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    most = np.minimum(n - only_a, m - only_b)
    return (100 + percent) * most >= percent * (n + m)


def _stacked(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


Names = dict[tuple[int, int], int]


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set; the first one is its name unless :func:`renamed` has another."""
    with np.errstate(over="ignore"):
        one = mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))
        two = mix((mix(s ^ np.uint64(0x5DEECE66D5DEECE6)) * np.uint64(0xD6E8FEB86659FD93)).sum(keepdims=True))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def renamed(rows: DataFrame) -> Names:
    """Names for sets whose first digest is that of another one too: one in 2**64 pairs of sets, so few at any size."""
    twice = rows.filter("n > 0").groupBy("set").agg(F.min("check").alias("_c"), F.max("check").alias("_d")).filter("_c <> _d").select("set", "_c")
    found = rows.join(F.broadcast(twice.limit(MOST_RENAMED)), "set").filter(F.col("check") != F.col("_c")).select("set", "check").distinct().limit(MOST_RENAMED).collect() if twice.limit(1).count() else []
    if len(found) >= MOST_RENAMED:
        raise ValueError("digests of sets are not spread as they should be")
    return {(one, two): two for one, two in found}


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Rows of two kinds. Of a text: key, print, n, set, check and bits. Of a task's part of the sketch: n = -1 - chunk, bits = counts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint8)  # full at 255 in a task, which is far above the usual
        names = ["key", "print", "n", "set", "check", "bits"]
        for batch in batches:
            places: list[np.ndarray] = []
            for row, end, data, offsets in pieces(batch.column("text")):
                sets = list(shingle_sets(data, offsets, size))
                places += [(s >> _SHIFT).astype(np.int32) for s in sets]
                n = np.array([len(s) for s in sets], np.int64)
                both = np.array([digests(s) for s in sets], np.int64).reshape(-1, 2)
                bits = [bitmap(s, width_of(b)) if len(s) else b"" for s, b in zip(sets, band_of(n), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(row, end - row), batch.column("print").slice(row, end - row), pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(bits, pa.binary())], names)
            if places:
                counts = np.minimum(counts + np.bincount(np.concatenate(places), minlength=SKETCH), 255).astype(np.uint8)
        chunks = [c for c in range(0, SKETCH, SKETCH_CHUNK) if counts[c : c + SKETCH_CHUNK].any()]
        if chunks:
            none = pa.nulls(len(chunks), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([-1 - c // SKETCH_CHUNK for c in chunks], pa.int64()), none, none, pa.array([counts[c : c + SKETCH_CHUNK].tobytes() for c in chunks], pa.binary())], names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(sign), "key long, print long, n long, set long, check long, bits binary")


def sketch_levels(signed: DataFrame) -> np.ndarray:
    """A byte for each counter: how far (in powers of two) its count is above twice the mean. SKETCH bytes, at any input."""

    def add(keys: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_CHUNK, np.int64)
        for x in table.column("bits"):
            total += np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"chunk": [keys[0].as_py()], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]}, pa.schema([("chunk", pa.int64()), ("counts", pa.binary())]))

    parts = signed.filter("n < 0").select((-1 - F.col("n")).alias("chunk"), "bits").groupBy("chunk").applyInArrow(add, "chunk long, counts binary")
    total = np.zeros(SKETCH, np.int64)
    for chunk, counts in parts.collect():  # SKETCH // SKETCH_CHUNK rows at most
        total[chunk * SKETCH_CHUNK : (chunk + 1) * SKETCH_CHUNK] = np.frombuffer(counts, np.int32)
    usual = 2 * max(1.0, float(total.mean()))
    return np.ceil(np.log2(np.maximum(total, usual) / usual)).astype(np.uint8)


def postings(docs: DataFrame, text: str, size: int, percent: int, levels: np.ndarray, names: Names) -> DataFrame:
    """(tile, set, n, guest): a row for each prefix shingle of each set and band; the tile mixes shingle and band."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                tiles: list[np.ndarray] = []
                of: list[tuple[int, int, int, bool]] = []
                for s in shingle_sets(data, offsets, size):
                    n = len(s)
                    if not n:
                        continue
                    both = digests(s)
                    name = names.get(both, both[0])
                    if name in done:
                        continue
                    if len(done) >= POSTED:
                        done.clear()
                    done.add(name)
                    prefix = n - int(needed(np.int64(n), percent)) + 1
                    order = np.argsort(level[(s >> _SHIFT).astype(np.int64)], kind="stable")  # s is sorted: ties by hash
                    found, band = s[order[:prefix]], int(band_of(np.int64(n)))
                    bands = [band] if n * 100 // percent < BAND ** (band + 1) else [band, band + 1]
                    for b in bands:
                        tiles.append(mix(found + np.uint64(b * 0x632BE5AB & 0xFFFFFFFF)))
                        of.append((prefix, name, n, b != band))
                if tiles:
                    times, *rest = (np.array(x) for x in zip(*of, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles).view(np.int64)), *(pa.array(np.repeat(x, times)) for x in rest)], ["tile", "set", "n", "guest"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(post), "tile long, set long, n long, guest boolean")


def shared_tiles(posted: DataFrame, percent: int) -> DataFrame:
    """Postings whose tile has another set of fitting size, each once.

    In the order of sizes, a set without a neighbour of fitting size has no partner in its tile. Sorted rows stream
    through, with a look at those beside each; no tile is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the one row that isn't decided yet
        last_fits = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.concat_batches([last, batch])
            tile, n, name = (rows.column(c).to_numpy() for c in ("tile", "n", "set"))
            same = np.concatenate([[False], (tile[1:] == tile[:-1]) & (name[1:] == name[:-1])])
            at = np.flatnonzero(~same)
            fits = np.concatenate([[last_fits], (tile[at[1:]] == tile[at[:-1]]) & (100 * n[at[:-1]] >= percent * n[at[1:]])])
            keep = at[:-1][fits[:-1] | fits[1:]]
            last, last_fits = rows.slice(int(at[-1]), 1), bool(fits[-1])
            if len(keep):
                yield rows.take(pa.array(keep))
        if last is not None and last_fits:
            yield last

    dealt = posted.repartition(partitions(posted), "tile").sortWithinPartitions("tile", "n", "set")
    return dealt.mapInArrow(tidy(run), "tile long, set long, n long, guest boolean")


def _by_bits(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, n, m, x, y, ...) the rows whose bitmaps x and y allow a link, without the bitmaps, with their overlap bound."""
    rest = [c for c in pairs.columns if c not in ("x", "y")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            wide = [np.array([width_of(b) for b in band_of(v)], np.int64) for v in (n, m)]
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column("x"), batch.column("y")
            for a, b in {*zip(wide[0].tolist(), wide[1].tolist(), strict=True)}:
                rows = np.flatnonzero((wide[0] == a) & (wide[1] == b))
                for some in np.array_split(rows, max(1, len(rows) * max(a, b) >> 24)):
                    keep[some] = may_link(_stacked(x.take(pa.array(some)).to_pylist()), _stacked(y.take(pa.array(some)).to_pylist()), n[some], m[some], percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in rest], rest)

    return pairs.mapInArrow(tidy(look), ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in rest))


def _exactly(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, names: Names, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets those that are linked, by intersection of their sorted shingle arrays."""
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    places = written(wanted.join(nodes, "set").select("set", "key"), "fetch")
    few = places.count() <= BROADCAST_ROWS
    keys = places.select(F.col("key").alias("_wanted")).distinct()
    some = docs.join(F.broadcast(keys) if few else keys, F.col(key).cast("long").eqNullSafe(F.col("_wanted")), "left_semi")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                sets = list(shingle_sets(data, offsets, size))
                both = [digests(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([names.get(x, x[0]) for x in both], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "hashes"])

    fetched = some.select(F.col(text).alias("text")).mapInArrow(tidy(arrays), "set long, hashes binary").join(places.select("set").distinct(), "set", "left_semi")
    held = written(fetched.groupBy("set").agg(F.first("hashes").alias("hashes")), "arrays")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append((100 + percent) * both >= percent * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    paired = pairs.select("a", "b").join(held.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    return paired.mapInArrow(tidy(meet), "a long, b long")


def _whole_tiles(batches: Iterator[pa.RecordBatch], tile: list[str]) -> Iterator[pa.Table]:
    """Sorted rows again, cut only where a tile ends."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        ids = np.stack([table.column(c).to_numpy() for c in tile])
        same = np.flatnonzero((ids != ids[:, -1:]).any(axis=0))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets of different groups in a tile whose bitmaps allow a link, from the first of the tiles that they share.

    rows: tile, one, two, block, set, n, guest, bits, group, and before, the BEFORE tiles of the set just before this
    one in the order of tiles. If one of a's is one of b's, both were there and the pair is known from there or from
    a tile still before; in the first tile that they share there is none."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tiles(batches, ["tile", "one", "two"]):
            col = {c: table.column(c).to_numpy() for c in ("tile", "one", "two", "block", "set", "n", "guest", "group")}
            bits = table.column("bits").to_pylist()
            wide = np.array([len(x) for x in bits])
            before = np.zeros((len(table), BEFORE), np.int64)
            for i, x in enumerate(table.column("before").to_pylist()):
                before[i, : len(x)] = x
            known = before != 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            live = np.arange(len(table))
            o = 0
            while len(live):
                o += 1
                live = live[live + o < len(table)]
                i, j = live, live + o
                live = live[(col["tile"][i] == col["tile"][j]) & (col["one"][i] == col["one"][j]) & (col["two"][i] == col["two"][j])]
                i, j = live, live + o
                n, m = col["n"][i], col["n"][j]
                fit = (col["group"][i] != col["group"][j]) & ~(col["guest"][i] & col["guest"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                fit &= (col["one"][i] == col["two"][i]) | (col["block"][i] != col["block"][j])
                i, j = i[fit], j[fit]
                for some in np.array_split(np.arange(len(i)), len(i) // _PAIRS + 1):
                    p, q = i[some], j[some]
                    again = ((before[p][:, :, None] == before[q][:, None, :]) & known[p][:, :, None]).any(axis=(1, 2))
                    if not again.all():
                        found.append((p[~again], q[~again]))
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = np.zeros(len(i), bool)
            for a, b in {*zip(wide[i].tolist(), wide[j].tolist(), strict=True)}:
                rows_of = np.flatnonzero((wide[i] == a) & (wide[j] == b))
                for some in np.array_split(rows_of, max(1, len(rows_of) * max(a, b) >> 24)):
                    keep[some] = may_link(_stacked([bits[k] for k in i[some]]), _stacked([bits[k] for k in j[some]]), col["n"][i[some]], col["n"][j[some]], percent)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(col["set"][i[keep]]), pa.array(col["set"][j[keep]])], ["a", "b"])

    return rows.mapInArrow(tidy(look), "a long, b long")


def _cells(left: DataFrame) -> DataFrame:
    """Rows of tiles of two groups or more, with the pair of blocks (one, two) in which they meet others, and before.

    A small tile is one block. The largest group of a large tile is dealt into blocks of its own, which meet the blocks
    of the other sets only. left: tile, set, n, guest, group."""
    by_group = left.groupBy("tile", "group").agg(F.count(F.lit(1)).alias("_n"))
    of_tile = by_group.groupBy("tile").agg(F.max(F.struct("_n", "group")).alias("_main"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_groups"))
    left = left.join(_small(written(of_tile.filter("_groups > 1"), "mixed")), "tile")
    # a guest's tiles are of another band than the set's own
    left = left.withColumn("before", F.collect_list("tile").over(Window.partitionBy("set", "guest").orderBy("tile").rowsBetween(-BEFORE, -1)))
    large, half = F.col("_all") > TILE, TILE // 2
    count = lambda n: F.when(large, F.ceil(n / half)).otherwise(F.lit(0)).cast("long")
    left = left.withColumns({"_m": count(F.col("_main._n")), "_r": count(F.col("_all") - F.col("_main._n")), "_in_main": F.col("group") == F.col("_main.group")})
    deal = F.when(F.col("_in_main"), F.pmod(F.xxhash64("set"), F.col("_m"))).otherwise(F.col("_m") + F.pmod(F.xxhash64("set"), F.col("_r")))
    first = F.when(large & F.col("_in_main"), F.col("_m")).otherwise(F.lit(0).cast("long"))
    last = F.when(large, F.col("_m") + F.col("_r") - 1).otherwise(F.lit(0).cast("long"))
    cut = left.withColumn("block", F.when(large, deal).otherwise(F.lit(0).cast("long"))).withColumn("_with", F.explode(F.sequence(first, last)))
    return cut.withColumns({"one": F.least("block", "_with"), "two": F.greatest("block", "_with")}).select("tile", "one", "two", "block", "set", "n", "guest", "group", "before")


def _small(table: DataFrame) -> DataFrame:
    """With a hint to broadcast it where its rows, which are counted, allow that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def similar_sets(docs: DataFrame, *, size: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the least key of the component) of every row of ``docs``."""
    signed = written(signatures(docs, key, text, size), "signed")
    rows = signed.filter("n >= 0")
    names = renamed(rows)
    for (one, two), name in names.items():
        rows = rows.withColumn("set", F.when((F.col("set") == one) & (F.col("check") == two), F.lit(name)).otherwise(F.col("set")))
    nodes = rows.filter("n > 0").groupBy("set").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")

    shared = written(shared_tiles(postings(docs, text, size, percent, sketch_levels(signed), names), percent), "shared")
    known = shared.groupBy("set").agg(F.count(F.lit(1)).alias("known"))
    of_tile = shared.join(known, "set").groupBy("tile").agg(F.max(F.struct("known", "set"))["set"].alias("hub"), F.count(F.lit(1)).alias("sets"))
    # written before it is joined, so that Spark can split a tile of very many sets
    tiles = written(shared.join(written(of_tile, "hubs"), "tile"), "tiles")

    part = nodes.select("set", "n", "bits")
    stars = tiles.filter(F.col("hub") != F.col("set")).groupBy(F.col("hub").alias("a"), F.col("set").alias("b")).agg(F.min("sets").alias("sets"), F.count(F.lit(1)).alias("tiles"))
    # of larger tiles a set tries the partners first that it meets in most of them
    tries = Window.partitionBy("b", F.col("sets") > 2).orderBy(F.desc("tiles"), "a")
    stars = stars.withColumn("_try", F.row_number().over(tries)).filter((F.col("sets") == 2) | (F.col("_try") <= FIRST_TRIES)).select("a", "b")
    stars = stars.join(part.select(F.col("set").alias("a"), "n", F.col("bits").alias("x")), "a").join(part.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    fitting = stars.filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    first = written(_exactly(written(_by_bits(fitting, percent), "pairs"), docs, nodes, names, key, text, size, percent), "first")
    groups = written(components(first, "a", "b"), "groups")

    left = tiles.filter("sets > 2").join(groups.withColumnRenamed("node", "set"), "set", "left")  # tiles of two sets are done
    # 0 stands for no tile
    left = left.select(F.when(F.col("tile") == 0, F.lit(1)).otherwise(F.col("tile")).alias("tile"), "set", "n", "guest", F.coalesce("root", "set").alias("group"))
    cut = _cells(left).join(part.select("set", "bits"), "set").select("tile", "one", "two", "block", "set", "n", "guest", "group", "bits", "before")
    dealt = cut.repartition(partitions(docs), "tile", "one", "two").sortWithinPartitions("tile", "one", "two")
    across = written(_across(dealt, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    second = _exactly(across, docs, nodes, names, key, text, size, percent)

    links = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
    roots = written(components(links, "a", "b"), "roots")
    held = nodes.select("set", "key", "copies").join(roots.withColumnRenamed("node", "set"), "set", "left").filter("copies > 1 OR root IS NOT NULL")
    held = written(held.select("set", "key", F.coalesce("root", "set").alias("root")), "held")
    least = written(held.groupBy("root").agg(F.min("key").alias("component_id")), "least")
    named = written(held.join(_small(least), "root").select("set", "root", "component_id"), "named")
    out = rows.select("key", "print", "n", "set").join(_small(named), "set", "left")
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component, F.when(F.col("n") > 0, F.coalesce("root", "set")).alias("group"), F.col("print"))


def without_near_copies(docs: DataFrame, *, size: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of :func:`similar_sets`, that of the least key, and all rows without words."""
    p = own_prefix(docs)
    found = written(similar_sets(docs, size=size, percent=percent, key=key, text=text), "groups").filter("group IS NOT NULL").withColumnRenamed(key, "key")
    row = F.struct(F.col("key").isNull().alias("none"), "key", "print")
    stays = found.groupBy("group").agg(F.min(row).alias("stays"))
    goes = written(found.join(stays, "group").filter(~(row == F.col("stays"))).select(F.col("key").alias(f"{p}key"), F.col("print").alias(f"{p}print")).distinct(), "copies")
    twice = found.groupBy(F.col("key").alias(f"{p}key"), F.col("print").alias(f"{p}print")).count().filter("count > 1").select(f"{p}key", f"{p}print")
    twice = written(twice, "repeated")
    same = F.col(key).eqNullSafe(F.col(f"{p}key")) & F.xxhash64(text).eqNullSafe(F.col(f"{p}print"))
    out = docs.join(_small(goes), same, "left_anti")
    if twice.limit(1).count():  # rows that are the same in key and text are told apart by nothing: one of them stays
        one = out.join(_small(twice), same, "left_semi").dropDuplicates([key, text])
        out = out.join(_small(twice), same, "left_anti").unionByName(one)
    return out
