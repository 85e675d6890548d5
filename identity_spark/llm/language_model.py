"""Language-model scores by deleted interpolation: n-gram estimates mixed by how often their contexts came.

The model gives a token the probability ``w0 / (V + 1) + w1 * c(w) / N + w2 * c(v w) / c(v) + w3 * c(u v w) / c(u v)``
for counts c of the training texts. The weights depend on the classes that the frequencies of the contexts v and u v fall
into. A part of the training texts is deleted from the counts, and expectation-maximisation finds the weights under which
the rest's estimates tell that part best; scores then use these weights with the counts of all training texts.

1. Texts become blocks: hashes of the block's words, and its tokens as numbers of these, in a written table.
2. A block sends each distinct n-gram once, with how often training texts of the block have it, to the part of the key
   space that the n-gram's hash falls into: sorted keys as differences, a packed piece for a block and part.
3. A part adds up its pieces and answers each of them with the counts of its n-grams, in the order of its keys. So all
   n-grams of the corpus are counted, a frequent one is a key of each block that has it, and no part has a hot key.
4. Blocks of deleted texts and their answers give a histogram of estimates, of a fixed size, for the weights.
5. All blocks and their answers give scores. Only blocks and answers meet by block; no row a token is ever made.

Parts grow in number with the tokens. Keys are 64-bit hashes, of n-grams of two words and more cut to 24 bits above the
logarithm of the corpus's tokens, so a look-up meets another n-gram's count with a chance of 2**-24 at most.

Defined results: a null or empty text is an end alone; a null key is not held out, and its texts are learnt from; rows of
one key and equal rows count and are scored each by itself; a text of any length is taken whole, in pieces; without
training texts all counts are 0; without deleted texts all weights of a context are equal; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy, written
from .words import BASE, PIECE_BYTES, hashed_words, mix, pieces

ORDER = 3
#: Tokens of a block, and keys of a part, about.
BLOCK_TOKENS = 3 << 19
PART_KEYS = 1 << 20
HELD_OUT, LEARNT, DELETED = 0, 1, 2
#: Of seven parts by crc32 of the key, the one that weights are learnt on.
DELETED_PART = 5
#: Stand for the end of a text and for what is before its first word.
END, START = np.uint64(0x5EED0E2D), np.uint64(0x57A127)
#: Frequencies of a context from which a class begins.
CLASSES = np.array([1, 2, 4, 8, 16, 64, 256, 1024])
#: Estimates are histogrammed by steps of this much in log10, down to LOWEST; means inside a step are exact to MICRO.
STEP, LOWEST, MICRO = 0.2, 9.0, 1_000_000
LEVELS = int(LOWEST / STEP) + 2
ROUNDS = 40
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = "block long, rows array<long>, keys array<long>, roles binary, sizes binary, cut binary, overlap int, words binary, tokens binary, n long, learnt long, deleted long"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0: byte planes, no more of them than the largest number has, compressed."""
    head, body = struct.pack("<i", len(arrays)), []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head += struct.pack("<qi", len(a), width)
        body.append(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = head + b"".join(body)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd", asbytes=True)
    n, at, out = struct.unpack_from("<i", raw)[0], 4, []
    heads = [struct.unpack_from("<qi", raw, at + 12 * k) for k in range(n)]
    at += 12 * n
    for size, width in heads:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(wide.view("<u8")[:, 0])
        at += size * width
    return out


class _Builder:
    """Tokens of texts until there are enough for a block."""

    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.row: list[int] = []
        self.key: list[int | None] = []
        self.role: list[int] = []
        self.size: list[int] = []
        self.begun: list[bool] = []
        self.ended: list[bool] = []
        self.n = self.overlap = 0

    def add(self, row: int, key: int | None, role: int, n: int, begins: bool, ends: bool) -> None:
        """A text's part, whose tokens are given by themselves."""
        self.n += n
        if not begins and self.row and self.row[-1] == row:
            self.size[-1] += n
            self.ended[-1] = ends
            return
        for x, to in ((row, self.row), (key, self.key), (role, self.role), (n, self.size), (begins, self.begun), (ends, self.ended)):
            to.append(x)

    def block(self, number: int) -> pa.RecordBatch:
        h = np.concatenate(self.tokens)
        words, at, n = np.unique(h, return_inverse=True, return_counts=True)
        common = np.argsort(-n, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[common] = np.arange(len(words))
        role, begun = np.array(self.role), np.array(self.begun)
        cut = ~(begun & np.array(self.ended))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (self.row, self.key)]
        # words in the order of their hashes are small to store; rank: a word's number by frequency
        data = [packed(role), packed(np.array(self.size)), packed(cut), packed(np.diff(words, prepend=np.uint64(0)), rank), packed(rank[at])]
        a, b, c, d, e = (pa.array([x], pa.binary()) for x in data)
        texts = [int((begun & (role == r)).sum()) for r in (LEARNT, DELETED)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, a, b, c, pa.array([self.overlap], pa.int32()), d, e, *(pa.array([x], pa.int64()) for x in (self.n, *texts))], [x.split()[0] for x in BLOCK.split(", ")])


def blocks_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of BLOCK. Deleted texts have blocks of their own, of odd numbers; a long text may go on in the next block, which
    then begins with the text's last tokens (overlap) as context."""
    part = F.crc32(F.col(key).cast("string").cast("binary")) % 7
    role = F.when(part == 2, HELD_OUT).when(part == DELETED_PART, DELETED).otherwise(LEARNT)
    most = BLOCK_TOKENS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 33
        builders = {False: _Builder(), True: _Builder()}
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column("text")):
                keys, roles = batch.column("key").slice(a, b - a).to_pylist(), batch.column("role").slice(a, b - a).to_numpy()
                if len(data) > PIECE_BYTES:
                    whole, at, deleted = data.tobytes(), 0, bool(roles[0] == DELETED)
                    while at < len(whole):
                        found = _SPACE.search(whole, at + PIECE_BYTES)
                        end = found.start() if found else len(whole)
                        h = hashed_words(data[at:end], np.array([0, end - at]))[0]
                        h = np.append(h, END) if end == len(whole) else h
                        to = builders[deleted]
                        to.tokens.append(h)
                        to.add(row, keys[0], int(roles[0]), len(h), at == 0, end == len(whole))
                        if to.n >= most:
                            yield to.block(2 * number + deleted)
                            number += 1
                            overlap = min(ORDER - 1, to.size[-1])
                            tail = np.concatenate(to.tokens)[-overlap:]
                            to = builders[deleted] = _Builder()
                            if end < len(whole):
                                to.tokens.append(tail)
                                to.overlap = overlap
                                to.add(row, keys[0], int(roles[0]), overlap, False, False)
                        at = end
                else:
                    h, before = hashed_words(data, offsets)
                    n = np.diff(before) + 1
                    tokens = np.full(len(h) + len(n), END)
                    inner = np.ones(len(tokens), bool)
                    inner[np.cumsum(n) - 1] = False
                    tokens[inner] = h
                    for deleted, to in builders.items():
                        own = (roles == DELETED) == deleted
                        if own.any():
                            to.tokens.append(tokens[np.repeat(own, n)])
                            for k in np.flatnonzero(own).tolist():
                                to.add(row + k, keys[k], int(roles[k]), int(n[k]), True, True)
                    for deleted, to in builders.items():
                        if to.n >= most:
                            yield to.block(2 * number + deleted)
                            number += 1
                            builders[deleted] = _Builder()
                row += b - a
        for deleted, to in builders.items():
            if to.row:
                yield to.block(2 * number + deleted)
                number += 1

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), role.alias("role")).mapInArrow(tidy(build), BLOCK)


@dataclass
class Tokens:
    """A block's tokens, as hashes of their words."""

    h: np.ndarray
    begins: np.ndarray  # where texts begin
    text: np.ndarray  # of each token, among the block's texts
    own: np.ndarray  # whether it is no context of a text that goes on
    role: np.ndarray  # of each text

    @classmethod
    def of(cls, r: dict) -> Tokens:
        words, rank = unpacked(r["words"])
        by_rank = np.empty(len(words), np.uint64)
        by_rank[rank.astype(np.int64)] = np.cumsum(words)
        h = by_rank[unpacked(r["tokens"])[0].astype(np.int64)]
        size = unpacked(r["sizes"])[0].astype(np.int64)
        begins = (np.cumsum(size) - size)[1 if r["overlap"] else 0 :]
        return cls(h, begins, np.repeat(np.arange(len(size), dtype=np.int32), size), np.arange(len(h)) >= r["overlap"], unpacked(r["roles"])[0])

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct sorted keys of the runs of n + 1 words that end at the tokens, and each token's place in them.

        They are made when they are asked for, so a block has those of one order at a time."""
        if not n:
            return self._numbered(self.h)
        key = np.zeros(len(self.h), np.uint64)
        for k in range(n, -1, -1):
            word = self.h
            if k:  # before a text's first word there is START
                word = np.full(len(self.h), START)
                word[k:] = self.h[:-k]
                for j in range(k):
                    word[self.begins[self.begins + j < len(word)] + j] = START
            key *= BASE
            key += word
            key = mix(key)
        key >>= np.uint64(64 - bits)
        return self._numbered(key)

    @staticmethod
    def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.empty(len(key), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        return key[new], at


def _asked(blocks: DataFrame, parts: int, bits: int) -> DataFrame:
    """Pieces: order, part, block, and body with keys and how often learnt and deleted texts of the block have each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("block", "roles", "sizes", "overlap", "words", "tokens")}
                t = Tokens.of(r)
                role = t.role[t.text].astype(np.int8)
                for n in range(ORDER):
                    u, at = t.grams(n, bits)
                    learnt, deleted = (np.bincount(at[t.own & (role == x)], minlength=len(u)) for x in (LEARNT, DELETED))
                    edges = np.append(np.searchsorted(u, _starts(parts, bits if n else 64)), len(u))
                    for p in np.flatnonzero(np.diff(edges)).tolist():
                        s = slice(edges[p], edges[p + 1])
                        body = packed(np.diff(u[s], prepend=np.uint64(0)), learnt[s], deleted[s])
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([p], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([body], pa.binary())], ["order", "part", "block", "body"])

    return blocks.select("block", "roles", "sizes", "overlap", "words", "tokens").mapInArrow(tidy(ask), "order int, part int, block long, body binary")


def _starts(parts: int, bits: int) -> np.ndarray:
    """The least key of each part."""
    return np.array([(p << bits) // parts for p in range(parts)], np.uint64)


def _answered(pieces: DataFrame, parts: int) -> DataFrame:
    """For each piece, order, part, block and body with its keys' counts in all training texts and in the deleted ones;
    for each part of single words a row without block, with distinct words and tokens, of all and without the deleted."""
    schema = "order int, part int, block long, body binary, words long, tokens long, words_left long, tokens_left long"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("order", "part", "block", "body")), strict=True)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda *x: pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True))], pa.schema([("order", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary()), *((c, pa.int64()) for c in names[4:])]))
        for (order, part), group in groupby(rows(batches), key=lambda r: r[:2]):
            block, keys, learnt, deleted = [], [], [], []
            for _, _, b, body in group:
                k, x, y = unpacked(body)
                block.append(b)
                keys.append(np.cumsum(k))
                learnt.append(x.astype(np.int64))
                deleted.append(y.astype(np.int64))
            ends = np.cumsum([len(k) for k in keys])
            flat = np.concatenate(keys)
            order_of = np.argsort(flat, kind="stable")
            ordered = flat[order_of]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            starts, at = np.flatnonzero(new), np.empty(len(flat), np.int64)
            at[order_of] = np.cumsum(new) - 1
            left, gone = (np.add.reduceat(np.concatenate(x)[order_of], starts) for x in (learnt, deleted))
            both = left + gone
            if order == 0:
                yield row(order, part, None, None, int((both > 0).sum()), int(both.sum()), int((left > 0).sum()), int(left.sum()))
            for b, own in zip(block, np.split(at, ends[:-1]), strict=True):
                yield row(order, part, b, packed(both[own], gone[own]), None, None, None, None)

    dealt = pieces.repartition(parts, "order", "part").sortWithinPartitions("order", "part")
    return dealt.mapInArrow(tidy(answer), schema)


@dataclass
class Totals:
    """Of training texts: distinct words with the end, tokens, texts."""

    words: int
    tokens: int
    texts: int


def estimates(t: Tokens, counts: list[np.ndarray], total: Totals, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each own token its class, maximum-likelihood estimates of all orders (0 where a context never came), and its count."""
    f, context = np.zeros((ORDER, len(t.text))), np.full(len(t.text), float(total.tokens))
    kind = np.zeros(len(t.text), np.int64)
    for n in range(ORDER):
        c = counts[n][t.grams(n, bits)[1]].astype(float)
        alone = c[t.own] if not n else alone
        np.divide(c, context, out=f[n], where=context > 0)
        if n:
            kind = kind * (len(CLASSES) + 1) + np.searchsorted(CLASSES, context, "right")
        context = np.concatenate([[0.0], c[:-1]])
        context[t.begins] = total.texts
    return kind[t.own], f[:, t.own], alone


def _with_answers(blocks: DataFrame, answers: DataFrame, parts: int, use, schema: str) -> DataFrame:
    """use(block's row, its tokens, counts by order in all training texts, and in the deleted ones) for every block."""
    names = ["block", "rows", "keys", "roles", "sizes", "cut", "overlap", "words", "tokens"]
    none = F.lit(None)
    types = {x.split()[0]: x.split()[1] for x in BLOCK.split(", ")}
    own = blocks.select(F.lit(-1).alias("order"), F.lit(-1).alias("part"), none.cast("binary").alias("body"), *names)
    theirs = answers.filter("block IS NOT NULL").select("order", "part", "body", *[F.col(c) if c == "block" else none.cast(types[c]).alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[dict, list[np.ndarray], list[np.ndarray]]]:
            r, both, gone = None, [], []
            for batch in batches:
                for i in range(batch.num_rows):
                    order = batch.column("order")[i].as_py()
                    if order < 0:
                        if r is not None:
                            yield r, both, gone
                        r = {c: batch.column(c)[i].as_py() for c in names}
                        both, gone = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
                    elif r is not None and batch.column("block")[i].as_py() == r["block"]:
                        x, y = unpacked(batch.column("body")[i].as_py())
                        both[order].append(x)
                        gone[order].append(y)
            if r is not None:
                yield r, both, gone

        for r, both, gone in each():
            join = lambda x: [np.concatenate(y).astype(np.int64) for y in x]
            yield from use(r, Tokens.of(r), join(both), join(gone))

    dealt = own.unionByName(theirs).repartition(parts, "block").sortWithinPartitions("block", "order", "part")
    return dealt.mapInArrow(tidy(run), schema)


def _histogram(blocks: DataFrame, answers: DataFrame, parts: int, bits: int, total: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, estimates and numbers of the deleted texts' tokens: a row for each cell that has any. The cells are of a
    fixed number, (len(CLASSES) + 1)**(ORDER - 1) * LEVELS**ORDER at most, and as many numbers as that come to the driver."""

    def count(r, t, both, gone):
        kind, f, _ = estimates(t, [x - y for x, y in zip(both, gone, strict=True)], total, bits)
        log = np.full(f.shape, LOWEST + STEP)
        np.log10(f, out=log, where=f > 0)
        log = np.where(f > 0, np.minimum(-log, LOWEST), LOWEST + STEP)
        cell = kind
        for n in range(ORDER):
            cell = cell * LEVELS + (log[n] / STEP).astype(np.int64)
        u, at = np.unique(cell, return_inverse=True)
        sums = [np.bincount(at, np.round(x * MICRO), len(u)).astype(np.int64) for x in log]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(at, minlength=len(u)).astype(np.int64)), *map(pa.array, sums)], ["cell", "n", *(f"l{k}" for k in range(ORDER))])

    logs = [f"l{k}" for k in range(ORDER)]
    found = _with_answers(blocks.filter("block % 2 = 1"), answers.filter("block % 2 = 1"), parts, count, f"cell long, n long, {', '.join(f'{c} long' for c in logs)}")
    rows = found.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in logs]).toPandas().sort_values("cell")
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy(float)
    log = rows[logs].to_numpy(float) / MICRO / np.maximum(n, 1)[:, None]
    return cell // LEVELS**ORDER, np.where(log > LOWEST, 0.0, 10.0**-log), n


def mixture(kind: np.ndarray, f: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """For each class the weights of a word chosen evenly and of the estimates of all orders, by expectation-maximisation.

    A class counts besides as one token of the mean of all, so one that never came has that; where a context never came,
    its estimate has no weight."""
    width = len(CLASSES) + 1
    all_kinds = np.arange(width ** (ORDER - 1))
    there = np.ones((len(all_kinds), ORDER + 1), bool)
    for k in range(ORDER - 1):
        there[:, k + 2] = all_kinds // width ** (ORDER - 2 - k) % width > 0
    x = np.column_stack([np.full(len(n), 1 / (words + 1)), f])
    w = there / there.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS if len(n) else 0):
        share = w[kind] * x
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        mean = np.where(there, share.sum(axis=0) / n.sum(), 0) + 1e-6 * there
        w = np.stack([np.bincount(kind, share[:, k], len(all_kinds)) for k in range(ORDER + 1)], axis=1)
        w += mean / mean.sum(axis=1, keepdims=True)
        w /= w.sum(axis=1, keepdims=True)
    return w


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (words by themselves) and score of every row."""
    blocks = written(blocks_of(docs, key, text), "blocks")
    seen = blocks.agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt"), F.sum("deleted").alias("deleted")).first()
    tokens, learnt, deleted = (seen[c] or 0 for c in ("n", "learnt", "deleted"))
    parts = max(partitions(docs), -(-tokens // PART_KEYS))
    bits = min(64, 24 + max(16, tokens.bit_length()))
    answers = written(_answered(_asked(blocks, parts, bits), parts), "answers")
    sums = answers.filter("block IS NULL").agg(*[F.sum(c).alias(c) for c in ("words", "tokens", "words_left", "tokens_left")]).first()
    total = Totals(sums["words"] or 0, sums["tokens"] or 0, learnt + deleted)
    left = Totals(sums["words_left"] or 0, sums["tokens_left"] or 0, learnt)
    weights = mixture(*_histogram(blocks, answers, parts, bits, left), left.words)

    def score(r, t, both, gone):
        kind, f, c = estimates(t, both, total, bits)
        w = weights[kind]
        p = w[:, 0] / (total.words + 1)
        for n in range(ORDER):
            p += w[:, n + 1] * f[n]
        text = t.text[t.own]
        base = np.log10((c + 1) / (total.tokens + total.words + 1))
        size = len(t.role)
        sums = [np.bincount(text, x, size) for x in (np.log10(p), base)]
        whole = [np.bincount(text, minlength=size), np.bincount(text, c > 0, size).astype(np.int64)]
        cut = unpacked(r["cut"])[0].astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(r["rows"], pa.int64()), pa.array(r["keys"], pa.int64()), pa.array(t.role == HELD_OUT), pa.array(cut), *map(pa.array, whole), *map(pa.array, sums)], ["row", "key", "held_out", "cut", "n_tokens", "n_known", "score", "base_score"])

    schema = "row long, key long, held_out boolean, cut boolean, n_tokens long, n_known long, score double, base_score double"
    found = written(_with_answers(blocks, answers, parts, score, schema), "scores")
    names = ["n_tokens", "n_known", "base_score", "score"]
    parts_of = found.filter("cut").groupBy("row").agg(F.first("key").alias("key"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in names])
    whole = found.filter("NOT cut").select("key", "held_out", *names).unionByName(parts_of.select("key", "held_out", *names))
    return whole.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score")
