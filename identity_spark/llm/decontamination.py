"""Benchmark decontamination by spaced seeds.

A word is a run of letters and digits, in lower case as far as ASCII goes. Masks of fixed shape slide over the words
of a text; a hash takes the words under a mask's ones and ignores the others, so a substituted word in a gap doesn't
break the seed. Seeds of benchmark items and of documents are joined by hash, and around each hit the aligned words
are compared: a document is contaminated if 13 successive words of an item stand in it with two substitutions at most
(an item of 8 to 12 words: the item, with one; of 1 to 7 words: the item as it is; a word beyond the document's end
counts as substituted). Three masks find every such window of 11 to 13 words, wherever its substitutions are. Shorter
items have masks of their own, one for each place of a substitution; documents are gone over with the masks of those
sizes only that the benchmark has.

A document emits a seed only where a bitmap of fixed size, filled with the benchmark's seeds, allows it; a wrong
yes costs a row of the join and nothing else. The words around a seed travel with it, so no text is shuffled.

Defined results: a null text has no words; items without words take no part; repeated items count once each;
rows with equal or null keys are judged each by its own text, repeated ones equally; a text of any length is gone over
whole, in memory of some 30 bytes for each of its own; further columns are kept, but for those that have a result's
name, which are replaced; an empty benchmark leaves all documents clean, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, tidy, written
from .words import BASE, PUNCTUATED, hashed_words, mix, pieces

WINDOW = 13
SUBSTITUTIONS = 2
#: Items of fewer words match without a substitution.
LEAST_WORDS = 8
#: Together the spaced ones hit each window of 13 words with any two of them substituted, and of 11 or 12 with any one.
SPACED = ("11110111", "111101011", "11001001111")
LEAST_SPACED = 11
#: (mask, least and most words of the items that it is for). An item with its first or last word substituted is a run of the others.
MASKS = (
    *((mask, LEAST_SPACED, None) for mask in SPACED),
    *(("1" * n, n, n) for n in range(1, LEAST_WORDS)),
    *(("1" * k + "0" * (0 < k) + "1" * (n - 1 - k), n, n) for n in range(LEAST_WORDS, LEAST_SPACED) for k in range(n - 1)),
)
#: Bits of the benchmark's bitmap.
BITMAP = 1 << 23
#: Beyond this many benchmark seeds (some 350 bytes each) or contaminated keys, joins are shuffles and not broadcasts.
BROADCAST_SEEDS = 50_000
BROADCAST_KEYS = 500_000
SPAN = max(len(mask) for mask, _, _ in MASKS)
#: Words before a seed that travel with it; after its start there are SPAN more than before.
AROUND = WINDOW - 1
WIDE = 2 * AROUND + SPAN


def _for_size(n: np.ndarray | int, least: int, most: int | None) -> np.ndarray | bool:
    return (n >= least) & (most is None or n <= most)


def masks_for(sizes: list[int]) -> list[int]:
    """Numbers of the masks that items of these sizes need."""
    return [k for k, (_, least, most) in enumerate(MASKS) if any(_for_size(n, least, most) for n in sizes)]


def _seeds(words: np.ndarray, before: np.ndarray, masks: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, whether a seed is a whole item) of all seeds that lie inside one row.

    masks: numbers of those to take; None: those for the row's own size."""
    places, hashes, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    sizes = np.diff(before)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(len(MASKS)) if masks is None else masks:
        mask, least, most = MASKS[k]
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        inside = row[:n] == row[len(mask) - 1 :]
        if masks is None:
            inside &= _for_size(sizes[row[:n]], least, most)
            if not inside.any():
                continue
        h = np.full(n, k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h = h * BASE + words[i : i + n]
        at = np.flatnonzero(inside)
        places.append(at)
        hashes.append(mix(h[at]))
        whole.append(np.full(len(at), most is not None and most < LEAST_WORDS))
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(whole)


def _around(words: np.ndarray, before: np.ndarray, row: np.ndarray, places: np.ndarray, missing: int) -> pa.Array:
    """For each place the words about it as bytes; ``missing`` stands for those outside of the row."""
    at = places[:, None] + np.arange(-AROUND, AROUND + SPAN)[None, :]
    there = (at >= before[row][:, None]) & (at < before[row + 1][:, None])
    out = np.where(there, words[np.clip(at, 0, max(0, len(words) - 1))], np.uint64(missing))
    return pa.array([x.tobytes() for x in out], pa.binary())


def seeds(rows: DataFrame, keys: list[str], missing: int, allowed: np.ndarray | None = None, masks: list[int] | None = None) -> DataFrame:
    """hash, keys, n_words and around of the seeds of (keys, text); allowed: bitmap that a hash's top bits must be in.

    A seed that is a whole item comes once a text."""
    shared = None if allowed is None else rows.sparkSession.sparkContext.broadcast(allowed)
    types = dict(rows.dtypes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                words, before = hashed_words(data, offsets, PUNCTUATED)
                places, hashes, whole = _seeds(words, before, masks)
                if shared is not None:
                    top = hashes >> np.uint64(64 - BITMAP.bit_length() + 1)
                    keep = (shared.value[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) == 1
                    places, hashes, whole = places[keep], hashes[keep], whole[keep]
                row = np.searchsorted(before, places, "right") - 1
                if whole.any():
                    at = np.flatnonzero(whole)
                    first_of = np.unique(np.stack([row[at].astype(np.uint64), hashes[at]], axis=1), axis=0, return_index=True)[1]
                    keep = np.concatenate([np.flatnonzero(~whole), at[first_of]])
                    places, hashes, row = places[keep], hashes[keep], row[keep]
                n = np.diff(before)[row]
                for some in np.array_split(np.arange(len(places)), len(places) // 20_000 + 1):
                    if len(some):
                        own = [batch.column(k).take(pa.array(first + row[some])) for k in keys]
                        yield pa.RecordBatch.from_arrays([pa.array(hashes[some].view(np.int64)), *own, pa.array(n[some]), _around(words, before, row[some], places[some], missing)], ["hash", *keys, "n_words", "around"])

    return rows.select(*keys, "text").mapInArrow(tidy(find), "hash long, " + "".join(f"{k} {types[k]}, " for k in keys) + "n_words long, around binary")


def bitmap(found: DataFrame) -> np.ndarray:
    """BITMAP bits as 64-bit words, set where a seed's top bits are; what is collected has BITMAP // 64 rows at most."""
    top = F.shiftrightunsigned("hash", 64 - BITMAP.bit_length() + 1)
    rows = found.select(top.alias("top")).select(F.shiftright("top", 6).alias("at"), F.expr("shiftleft(1L, cast(top & 63 as int))").alias("bit"))
    out = np.zeros(BITMAP // 64, np.int64)
    for at, bits in rows.groupBy("at").agg(F.bit_or("bit")).collect():
        out[at] = bits
    return out.view(np.uint64)


def _verified(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item and the most words that a window of the item shares with the document, for windows that share enough."""
    types = dict(hits.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE) for c in ("around", "item_around"))
            same, inside = (x == y).astype(np.int64), (y != 1).astype(np.int64)
            n = batch.column("item_words").to_numpy()
            best = np.zeros(len(n), np.int64)
            for size in np.unique(np.minimum(n, WINDOW)).tolist():
                rows = np.flatnonzero(np.minimum(n, WINDOW) == size)
                sums = [np.pad(np.cumsum(m[rows], axis=1), ((0, 0), (1, 0))) for m in (same, inside)]
                shared, whole = (s[:, size:] - s[:, :-size] for s in sums)
                shared = np.where(whole == size, shared, 0).max(axis=1)
                best[rows] = np.where(shared >= size - (size * SUBSTITUTIONS // WINDOW if size >= LEAST_WORDS else 0), shared, 0)
            keep = pa.array(best > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in [*keys, "item"]), pa.array(best[best > 0])], [*keys, "item", "shared"])

    return hits.mapInArrow(tidy(compare), "".join(f"{k} {types[k]}, " for k in [*keys, "item"]) + "shared long")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, print (of the text), item and shared (words of the best window) of each document and item that overlap."""
    known = seeds(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), ["item"], 1)
    known = written(known.withColumnsRenamed({"n_words": "item_words", "around": "item_around"}), "seeds")
    few = known.count() <= BROADCAST_SEEDS
    masks = masks_for([r["n"] for r in known.select(F.least("item_words", F.lit(WINDOW)).alias("n")).distinct().collect()])
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    hits = seeds(rows, ["key", "print"], 0, bitmap(known), masks).drop("n_words").join(F.broadcast(known) if few else known, "hash")
    found = _verified(hits, ["key", "print"]).groupBy("key", "print", "item").agg(F.max("shared").alias("shared"))
    return found


def _contaminated(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str) -> tuple[DataFrame, Column, str]:
    """(keys and prints of contaminated texts with their figures, condition that a row of ``docs`` is one of them, the
    figures' prefix)."""
    p = own_prefix(docs)
    found = overlaps(docs, benchmark, key=key, text=text, item=item)
    of_doc = found.groupBy("key", "print").agg(F.count(F.lit(1)).alias(f"{p}n"), F.min("item").alias(f"{p}item"), F.max("shared").alias(f"{p}shared"))
    of_doc = written(of_doc.withColumnsRenamed({"key": f"{p}key", "print": f"{p}print"}), "contaminated")
    same = F.col(key).eqNullSafe(F.col(f"{p}key")) & (F.xxhash64(text) == F.col(f"{p}print"))
    return F.broadcast(of_doc) if of_doc.count() <= BROADCAST_KEYS else of_doc, same, p


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """All columns of ``docs`` and n_items, first_item (the least id) and shared_words; these are 0, null and 0 for clean ones.

    Columns of ``docs`` with these names are replaced."""
    of_doc, same, p = _contaminated(docs, benchmark, key, text, item)
    zero = F.lit(0).cast("long")
    out = docs.drop("n_items", "first_item", "shared_words").join(of_doc, same, "left").withColumns({"n_items": F.coalesce(f"{p}n", zero), "first_item": F.col(f"{p}item"), "shared_words": F.coalesce(f"{p}shared", zero)})
    return out.drop(f"{p}key", f"{p}print", f"{p}n", f"{p}item", f"{p}shared")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with their own columns."""
    of_doc, same, _ = _contaminated(docs, benchmark, key, text, item)
    return docs.join(of_doc, same, "left_anti")
