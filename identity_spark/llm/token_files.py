"""Token ids as Parquet files that can be read in part.

Rows are dealt by range of their key and sorted, so that files in the order of their part numbers hold ascending
keys. One row is one document: key, part, first id's place inside its part, number of ids, and the ids. Spark's own
writer makes the files, with settings that matter to a reader of some rows or columns:

* numbers other than ids (sorted keys, running places) are delta encoded, since dictionaries are off for them;
* ids have a dictionary where it pays, which the writer decides for each column chunk, and delta encoding else;
* row groups and pages are small, and page indexes are written, so that a reader of a key range or of the lengths
  touches those pages alone.

Defined results: a null text is empty; every document ends with ``end_id``, an empty one has that id alone; a null key
sorts first; rows of one key are ordered by checksum of the text; repeated rows are written as often as they come; a
text of any length is encoded whole, in memory of some 30 bytes for each of its own; an empty table gives files without
rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, tidy
from .memory import SHORT, StretchEncoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2_000
#: Stretches that a worker remembers before it begins anew.
REMEMBERED = 1_000_000
#: Texts that are encoded together.
ROWS_AT_ONCE = 1024
#: Stretches that are joined to be encoded.
JOINED = 128
_SPACE = np.array([b in b"\t\n\x0b\x0c\r " for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: Signs that end a token after a letter, whatever follows.
_SIGN = np.array([b in b".,!?;:" for b in range(256)])
#: White space of the tokenizer's pattern beyond ASCII, in UTF-8.
_WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_BLANK_WORD = re.compile(rb" [^\s]+")


class Encoder(StretchEncoder):
    """Ids of texts by a byte-level BPE tokenizer file.

    Stretches begin and end where the tokenizer's own pieces do: a blank before a word belongs to the word, other white
    space stands by itself up to its last character, and a sign after a letter begins a piece. A text with white space
    beyond ASCII, or with the string of a special token, which is found before any piece, is one stretch."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: what makes a text one stretch
        self.whole = re.compile(b"|".join([_WIDE_SPACE, *special]))
        #: whether a token begins with a blank, as the vocabulary writes it
        self.first = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.first[[i for x, i in self.tokenizer.get_vocab().items() if x[0] == "\u0120"]] = True

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = offsets[:-1][offsets[:-1] < len(data)]
        edge = np.zeros(len(data), bool)
        if not len(data):
            return np.zeros(0, np.int64)
        space = _SPACE[data]
        new = np.zeros(len(data) + 1, bool)  # where a row begins, or the data ends
        new[begins], new[-1] = True, True
        before, after = np.concatenate([[False], space[:-1]]), np.concatenate([space[1:], [False]])
        blank_before = np.concatenate([[False], data[:-1] == 32])
        edge = ~space & before & ~blank_before  # a word after other white space
        edge |= space & (~before | ~after & ~new[1:])  # white space, and its last character before a word
        edge[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        edge |= new[:-1]
        for row in np.unique(np.searchsorted(offsets, [m.start() for m in self.whole.finditer(data.tobytes())], "right") - 1).tolist():
            edge[offsets[row] + 1 : offsets[row + 1]] = False
        return np.flatnonzero(edge)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        flat, at, out = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0, []
        for x in ids:
            out.append(flat[at : at + 4 * len(x)])
            at += 4 * len(x)
        return out

    def learn(self, stretches: list[bytes]) -> list[bytes]:
        """Words after a blank are encoded joined: no token but a word's first one has a blank in it."""
        out: list[bytes] = [b""] * len(stretches)
        words = [i for i, x in enumerate(stretches) if x[0] == 32 and len(x) <= SHORT and _BLANK_WORD.fullmatch(x) and not self.whole.search(x)]
        joined = [b"".join([stretches[i] for i in words[k : k + JOINED]]) for k in range(0, len(words), JOINED)]
        flat = np.frombuffer(b"".join(self._encode(joined)), "<u4")
        cuts = [*(4 * np.flatnonzero(self.first[flat])).tolist(), 4 * len(flat)]
        whole = flat.tobytes()
        for i, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            out[i] = whole[a:b]
        rest = sorted(set(range(len(stretches))).difference(words))
        for i, x in zip(rest, self._encode([stretches[i] for i in rest]), strict=True):
            out[i] = x
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, *, key: str, text: str, end_id: int) -> DataFrame:
    """key, part, place (of the first id, inside its part), n_tokens and ids, dealt and sorted by key."""
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), words.alias("text"))
    rows = rows.repartitionByRange(partitions(docs), "key", F.crc32(F.col("text").cast("binary"))).sortWithinPartitions("key", F.crc32(F.col("text").cast("binary")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer)
        place = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                ids, stops = encode_all.encode(some.column("text"))
                ends = stops + np.arange(1, some.num_rows + 1)
                n = np.diff(ends, prepend=0)
                values = np.full(int(ends[-1]), end_id, np.int32)
                own = np.ones(len(values), bool)
                own[ends - 1] = False
                values[own] = ids
                yield pa.RecordBatch.from_arrays(
                    [some.column("key"), some.column("part"), pa.array(place + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))],
                    ["key", "part", "place", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(encode), "key long, part int, place long, n_tokens long, ids array<int>")


def write_tokens(rows: DataFrame, path: str) -> None:
    """Files of ``rows`` of :func:`encoded` with the settings above."""
    narrow = {f"parquet.enable.dictionary#{c}": "false" for c in ("key", "part", "place", "n_tokens")}
    rows.write.options(**narrow).options(**{
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "true", "compression": "lz4_raw",
    }).parquet(path)


def read_tokens(spark: SparkSession, path: str, keys: tuple[int, int] | None = None) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids of the files in ``path``.

    keys: the least and highest key to read, of which Parquet then reads those row groups and pages alone that can hold
    them; a caller that selects no ids reads no page of them. The start needs the sums of the parts before; these come from two narrow columns, one row for each part."""
    rows = spark.read.schema("key long, part int, place long, n_tokens long, ids array<int>").parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    # parts are as many as the session's shuffle partitions, whatever the table's size
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sums.select(F.col("part").alias("later"), F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("before")))
    if keys is not None:
        rows = rows.filter(F.col("key").between(*keys))
    return rows.join(before, F.col("part") == F.col("later")).select("key", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """key, start, n_tokens and ids_crc32, over the ids as little-endian unsigned 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "start", "n_tokens")), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(tidy(sums), "key long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` to ``path`` (a new one in the shared folder if None) and reads them back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(encoded(docs, tokenizer, key=key, text=text, end_id=end_id), path)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("key", key)
