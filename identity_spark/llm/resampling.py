"""Importance resampling towards a target distribution of hashed n-grams, by an external sort-count.

1. Every text becomes a stream of buckets, one for each run of one to three words, packed as unsigned 16-bit numbers.
   Streams are written as a table: a row holds those of some documents with their offsets, or a part of one long text.
2. Each row's stream is sorted and run-length encoded; Spark adds up the runs of all rows, so no count is held anywhere
   but for one number a bucket.
3. A bucket's gain is the logarithm of what the target holds of it to what the corpus holds. The written streams are read
   again, gains are gathered by bucket and added up between offsets, which gives a text's weight.
4. Weights get Gumbel noise that follows from the seed and the key; the highest are drawn, without replacement.

A feature's bucket is the crc32 of its UTF-8 bytes; that of a run of words is combined from those of its words, for all
runs of a piece of text at once.

Defined results: a null text has no words, so no features and weight 0; a null key counts as "" in the noise and goes
before all others among ties; rows that are equal in key and text are ranked one after the other in any order; texts of
any length are taken whole, in pieces; an empty target has counts of 0; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written
from .sharding import numbered
from .words import PIECE_BYTES, pieces

#: What a byte stands for: A-Z for a-z, all ASCII that is neither digit nor letter for a blank.
_WORDY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
STREAM = "first_row long, keys array<long>, ends array<int>, cut boolean, stream binary"


def _tables() -> np.ndarray:
    """At [k, j]: what 2**k further zero bytes make of byte j of a crc32."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    step = [one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(3))]
    out = [np.stack(step)]
    while len(out) < 32:
        out.append(_later(out[-1], out[-1]))
    return np.stack(out)


def _later(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> np.uint32(8)) & 255] ^ table[2][(x >> np.uint32(16)) & 255] ^ table[3][x >> np.uint32(24)]


_ZEROS = _tables()


def joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of strings of crc32 ``a``, each followed by one of crc32 ``b`` and ``size`` bytes."""
    a = a.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        on = np.flatnonzero((size >> k) & 1)
        a[on] = _later(a[on], _ZEROS[k])
    return a ^ b


def _numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words))


def features(crc: np.ndarray, size: np.ndarray, of: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of all runs of one to three words of a text each, ordered by their last word, and how many end at each word.

    of: the text of each word; known: words at the front whose own runs were given before."""
    n = len(crc)
    out, there = np.zeros((n, 3), np.uint32), np.zeros((n, 3), bool)
    out[:, 0], there[:, 0] = crc, True
    blank = np.uint32(zlib.crc32(b" "))
    after = joined(np.full(n, blank), crc, size)
    for k in (1, 2):
        if n > k:
            out[k:, k] = joined(out[k - 1 : -1, k - 1], after[k:], size[k:] + 1)
            there[k:, k] = of[k:] == of[:-k]
    return out[known:][there[known:]], there[known:].sum(axis=1)


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text's words in parts of some PIECE_BYTES, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def bucket_streams(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Rows of STREAM: buckets of the features of some documents, and where each one's end; cut: of a part of one text.

    Rows of the table are numbered; the parts of a text have one number."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is an unsigned 16-bit number")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33

        def packed(first: int, keys: pa.Array, ends: np.ndarray, cut: bool, crc: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, pa.array(ends.astype(np.int32)))]
            data = (crc % np.uint32(buckets)).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *lists, pa.array([cut]), pa.array([data], pa.binary())], ["first_row", "keys", "ends", "cut", "stream"])

        for batch in batches:
            for a, b, data, offsets in pieces(batch.column("text")):
                clean = data.tobytes().translate(_WORDY)
                keys = batch.column("key").slice(a, b - a)
                if len(clean) > PIECE_BYTES:
                    last, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                    for part in _chunks(clean):
                        known = len(last)
                        more = _numbers(part.split())
                        last, size = np.concatenate([last, more[0]]), np.concatenate([size, more[1]])
                        crc, _ = features(last, size, np.zeros(len(last), np.int8), known)
                        yield packed(row, keys, np.array([len(crc)]), True, crc)
                        last, size = last[-2:], size[-2:]
                else:
                    words = [clean[i:j].split() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    of = np.repeat(np.arange(b - a), [len(x) for x in words])
                    crc, n = features(*_numbers([w for x in words for w in x]), of)
                    ends = np.cumsum(np.bincount(of, n, b - a)).astype(np.int64)
                    yield packed(row, keys, ends, False, crc)
                row += b - a

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(tidy(stream), STREAM)


def counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in the streams: runs of each sorted stream, added up by Spark to a number for each bucket."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("stream"):
                ordered = np.sort(np.frombuffer(x.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ 1)) if len(ordered) else np.zeros(0, np.int64)
                n = np.diff(starts, append=len(ordered))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[starts].astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(tidy(runs), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths: the logarithm of its share of the target to that of the corpus, both smoothed by one."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([floor(1000 * log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, key, n_features and weight of each document: the sum of its features' gains."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = gain[np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")]
                ends = batch.column("ends")[i].values.to_numpy().astype(np.int64)
                n = np.diff(ends, prepend=0)
                out, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
                if len(some):
                    out[some] = np.add.reduceat(values, (ends - n)[some])
                rows = batch.column("first_row")[i].as_py() + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("keys")[i].values, pa.array(n), pa.array(out)], ["row", "key", "n_features", "weight"])

    of = lambda cut: streams.filter(F.col("cut") == cut).mapInArrow(tidy(gathered), "row long, key long, n_features long, weight long")
    parts = of(True).groupBy("row").agg(F.first("key").alias("key"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    return of(False).unionByName(parts)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, buckets: int = 10_000, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank of every row of ``docs``; rank is null where a row isn't drawn.

    Of the rows with ``least_words`` words and more, ``percent`` of a hundred are drawn. All rows are numbered in one
    order, those that can be drawn first, so nothing but narrow rows is dealt and sorted, by range."""
    streams = written(bucket_streams(docs, key, text, buckets), "streams")
    wanted = written(bucket_streams(target.withColumn("_none", F.lit(None).cast("long")).select("_none", F.col(target_text).alias("text")), "_none", "text", buckets), "target")
    scored = weights(streams, gains(counts(streams, buckets), counts(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    # n words have 3n - 3 features, one has one
    fit = F.col("n_features") >= (3 * least_words - 3 if least_words > 1 else least_words)
    rows = written(scored.withColumns({"score": F.col("weight") + noise, "fit": fit}), "weights")
    drawn = rows.filter("fit").count() * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("key"), F.asc("row")]
    ranked, _ = numbered(rows, order, "place", "ranked")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))
