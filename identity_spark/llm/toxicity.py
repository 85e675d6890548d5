"""Toxicity of whole texts: character n-gram vectors, averaged into a linear softmax and trained jointly.

A word is a run of letters and digits in lower case. Its vector is the mean of the vectors of its n-grams (3 to 5
characters, its beginnings, its endings and itself, hashed into a fixed table), so a misspelling shares most of its
vector with the word. A window of words is the mean of its words, which a linear softmax classifies; a text is as toxic
as its worst window. Vectors and softmax are trained together by mini-batches in numpy on windows of a bounded sample
of labelled rows: first every window of a toxic text counts as toxic, then only its worst ones. A logistic curve over
the worst window's logit, weighted to the label counts of the whole table, makes the score.

The softmax is linear, so after training a word needs one number: scoring is sums of these over sliding windows of the
whole text. Labels and texts are the model's only inputs.

Defined results: a null or empty text, or one without words, gets the score of an empty window; labels other than 0
and 1, null labels and labels without a document are ignored; repeated labels count as often as they come; with no
label of a class every score is 0.0, or 1.0 if only toxic ones are there; a null key is scored as any other and takes
part in no label; equal texts and repeated rows have equal scores; a text of any length is scored whole, in memory of
some 60 bytes for each of its own; an empty table gives no rows; further columns are kept, but for one that has the
score's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import BASE, INVERSE, mix

#: Most labelled rows of each class that a model is fitted on: those of the least hashed keys.
SAMPLE = {0: 3000, 1: 2000}
#: Most bytes of text of each class in the sample: a row that would go beyond is left out.
SAMPLE_BYTES = {0: 24_000_000, 1: 16_000_000}
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 6
#: A window of fewer words is averaged as if it had this many.
LEAST_WORDS = 4
EPOCHS = (3, 4)
#: A smaller sample is gone over more often, up to ten times as often.
FULL = 4000
RATE = 0.15
SEED = 11
PIECE_CHARS = 1 << 18

_WORDY = np.array([chr(c).isalnum() for c in range(0x10000)])


@dataclass
class Words:
    """Distinct words of some texts, as n-gram buckets in one run, and the texts as numbers of these words."""

    grams: np.ndarray  # buckets, word after word
    starts: np.ndarray  # of each word in grams; one more for the end
    tokens: np.ndarray  # word numbers, text after text
    before: np.ndarray  # tokens before each text; one more for the end
    hashes: np.ndarray  # of the words


def all_words(texts: list[str]) -> Words:
    """As :func:`words_of`, in pieces of about PIECE_CHARS of which only new words are kept: memory follows the distinct
    words and the tokens, which are numbered as the words come."""
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes and the numbers of their words
    hashes, grams, sizes, tokens, counts = [], [], [], [], []
    at = 0
    while at < len(texts) or not counts:
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE_CHARS):
            size += len(texts[end])
            end += 1
        p = words_of(texts[at:end])
        place = np.minimum(np.searchsorted(known, p.hashes), max(0, len(known) - 1))
        old = known[place] == p.hashes if len(known) else np.zeros(len(p.hashes), bool)
        own = np.empty(len(p.hashes), np.int32)
        own[old] = number[place[old]]
        new = np.flatnonzero(~old)
        own[new] = len(known) + np.arange(len(new))
        size_of = np.diff(p.starts)
        grams.append(p.grams[np.repeat(~old, size_of)])
        sizes.append(size_of[new])
        hashes.append(p.hashes[new])
        tokens.append(own[p.tokens])
        counts.append(np.diff(p.before))
        known, number = np.concatenate([known, p.hashes[new]]), np.concatenate([number, own[new]])
        order = np.argsort(known, kind="stable")
        known, number = known[order], number[order]
        at = max(end, at + 1)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return Words(np.concatenate(grams), starts, np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(hashes))


def words_of(texts: list[str]) -> Words:
    """All at once: hashes of words and n-grams are differences of running sums over the code points."""
    joined = "\n".join(texts).lower() if len(texts) > 1 else texts[0].lower() if texts else ""
    lengths = np.array([len(t.lower()) for t in texts], np.int64) if len(joined) != sum(map(len, texts)) + max(0, len(texts) - 1) else np.array([len(t) for t in texts], np.int64)
    ends_of_text = np.cumsum(lengths + 1)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    wordy = np.where(points < 0x10000, _WORDY[np.minimum(points, 0xFFFF)], False)
    edges = np.diff(np.concatenate([[0], wordy.view(np.int8), [0]]))
    a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    before = np.concatenate([[0], np.searchsorted(a, ends_of_text)])
    power = np.full(len(points) + 1, BASE, np.uint64)
    power[0] = 1
    back = np.full(len(points) + 1, INVERSE, np.uint64)
    back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    part = lambda i, j, salt: mix((sums[j] - sums[i]) * back[i] + np.uint64(salt))
    known, first, tokens = np.unique(part(a, b, 1), return_index=True, return_inverse=True)
    a, b = a[first], b[first]
    n = b - a
    of, hashes = [np.arange(len(a))], [part(a, b, 1)]
    for k in GRAMS:
        count = np.maximum(0, n - k + 1)
        word = np.repeat(np.arange(len(a)), count)
        i = a[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        of.append(word)
        hashes.append(part(i, i + k, 2))
        if k < GRAMS[-1]:
            long = np.flatnonzero(n > k)
            of += [long, long]
            hashes += [part(a[long], a[long] + k, 3), part(b[long] - k, b[long], 4)]
    of_all, grams = np.concatenate(of), np.concatenate(hashes) & np.uint64(BUCKETS - 1)
    order = np.argsort(of_all, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(of_all, minlength=len(a)))])
    return Words(grams[order].astype(np.int32), starts, tokens.astype(np.int32), before, known)


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that aren't empty."""
    return np.add.reduceat(values, starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, *values.shape[1:]), values.dtype)


def worst_windows(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each text the highest mean of ``value`` over windows of WINDOW words; 0 for a text without words."""
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    n = np.diff(before)
    out = np.zeros(len(n))
    short = (n > 0) & (n <= WINDOW)
    out[short] = (sums[before[1:][short]] - sums[before[:-1][short]]) / np.maximum(n[short], LEAST_WORDS)
    if (n > WINDOW).any():
        means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
        for i in np.flatnonzero(n > WINDOW):
            out[i] = means[before[i] : before[i + 1] - WINDOW + 1].max()
    return out


@dataclass
class Model:
    """A number for each n-gram bucket, the softmax's bias, and the curve over the worst window's logit."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def words(self, w: Words) -> np.ndarray:
        return _segments(self.weight[w.grams], w.starts) / np.diff(w.starts)

    def logits(self, w: Words) -> np.ndarray:
        return worst_windows(self.words(w)[w.tokens] if len(w.tokens) else np.zeros(0), w.before) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(words_of(texts)) + self.shift, -50, 50)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on one number, by Newton's steps."""
    mean, spread = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = (x - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * z), np.sum(weight * (p - y))]) + np.array([1e-2 * a, 0])
        h = weight * p * (1 - p)
        m = np.array([[np.sum(h * z * z) + 1e-2, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a / spread, b - a * mean / spread


def fit(texts: list[str], labels: list[int], prior: tuple[int, int]) -> Model:
    """A model of the whole sample, its curve from models of either half on the other one.

    prior: rows of class 0 and 1 in the whole table of labels."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 50.0 if 1 in labels else -50.0)
    w = all_words(texts)
    half = np.zeros(len(y), int)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = 1
    x = np.zeros(len(y))
    for k in (0, 1):
        x[half == k] = _jointly(w, y, half != k).logits(w)[half == k]
    model = _jointly(w, y, np.ones(len(y), bool))
    weight = np.where(y == 1, prior[1] / max(1, (y == 1).sum()), prior[0] / max(1, (y == 0).sum()))
    model.slope, model.shift = _curve(x, y, weight)
    return model


def _jointly(w: Words, y: np.ndarray, used_texts: np.ndarray) -> Model:
    """Vectors and softmax, trained together on windows of some of the texts."""
    rng = np.random.default_rng(SEED)
    # all windows of each text
    count = np.where(used_texts, -(-np.diff(w.before) // WINDOW), 0).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    start = w.before[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + WINDOW, w.before[doc + 1])
    n_grams = np.diff(w.starts)
    vectors = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.5, DIM)
    out[:, 0] = -out[:, 1]
    bias = np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def epoch(rows: np.ndarray, target: np.ndarray) -> None:
        # windows of both classes weigh the same in sum
        share = np.array([1.0, max(1.0, (target[rows] == 0).sum() / max(1, (target[rows] == 1).sum()))])
        for some in np.array_split(rng.permutation(rows), max(1, len(rows) // 1000)):
            size = end[some] - start[some]
            token = np.repeat(start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            used, of = np.unique(w.tokens[token], return_inverse=True)
            count = n_grams[used]
            gram = w.grams[np.repeat(w.starts[used] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            runs = np.concatenate([[0], np.cumsum(count)])
            word = _segments(vectors[gram], runs) / count[:, None]
            weight = (1 / np.maximum(size, LEAST_WORDS)).astype(np.float32)
            mean = _segments(word[of], np.concatenate([[0], np.cumsum(size)])) * weight[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), target[some]] -= 1
            p *= (share[target[some]] / share[target[some]].sum())[:, None].astype(np.float32) * 200
            g_out, g_bias, g_mean = mean.T @ p, p.sum(axis=0), (p @ out.T) * weight[:, None]
            by_token = np.repeat(g_mean, size, axis=0)
            g_word = np.stack([np.bincount(of, by_token[:, d], len(used)) for d in range(DIM)], axis=1) / count[:, None]
            by_gram = np.repeat(g_word, count, axis=0)
            touched, to = np.unique(gram, return_inverse=True)
            g_vec = np.stack([np.bincount(to, by_gram[:, d], len(touched)) for d in range(DIM)], axis=1).astype(np.float32)
            seen[touched] += g_vec * g_vec
            vectors[touched] -= RATE * g_vec / np.sqrt(seen[touched])
            np.add(seen_out, g_out * g_out, out=seen_out)
            np.subtract(out, RATE * g_out / np.sqrt(seen_out), out=out)
            np.add(seen_bias, g_bias * g_bias, out=seen_bias)
            np.subtract(bias, RATE * g_bias / np.sqrt(seen_bias), out=bias)

    def linear() -> Model:
        return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)

    target = y[doc]
    rows = np.arange(len(doc))
    more = int(min(10, max(1, FULL // max(1, used_texts.sum()))))
    for _ in range(EPOCHS[0] * more):
        epoch(rows, target)
    for _ in range(EPOCHS[1] * more):
        value = linear().words(w)[w.tokens]
        sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        own = (sums[end] - sums[start]) / np.maximum(end - start, LEAST_WORDS) + float(bias[1] - bias[0])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, own)
        epoch(rows[(target == 0) | (own >= np.minimum(best[doc], 0.0))], target)
    return linear()


def held_out(key: str) -> Column:
    """True for rows that no label is learnt from: crc32 of the key as text, modulo 5, is 0. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labels of rows that aren't held out; SAMPLE and SAMPLE_BYTES bound the sample at any size of table."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    different = usable.distinct()
    counts = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [different.filter(F.col("_label") == c).orderBy(F.xxhash64("_key"), "_key").limit(n) for c, n in SAMPLE.items()]
    # the broadcast side has as many rows as SAMPLE allows at most
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "_key")
    # where a key repeats, the text of the least hash stands for it
    least = F.min(F.struct(F.xxhash64("_text").alias("hash"), F.coalesce("_text", F.lit("")).alias("text")))["text"]
    room, sample = dict(SAMPLE_BYTES), []
    for r in rows.groupBy("_key", "_label").agg(least.alias("_text")).orderBy(F.xxhash64("_key"), "_key", "_label").toLocalIterator():
        room[r["_label"]] -= (size := len(r["_text"].encode()))
        if room[r["_label"]] >= 0:
            sample.append(r)
        else:
            room[r["_label"]] += size
    sample.sort(key=lambda r: (r["_key"], r["_text"], r["_label"]))
    return fit([r["_text"] for r in sample], [r["_label"] for r in sample], (counts.get(0, 0), counts.get(1, 0)))


def toxicity(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text as ``out``, in place of a column of that name."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) // PIECE_CHARS
            for piece in range(int(size[-1]) + 1 if len(size) else 0):
                rows = np.flatnonzero(size == piece)
                if len(rows):
                    some = batch.slice(int(rows[0]), len(rows))
                    scores = shared.value.score(some.column(text).fill_null("").to_pylist())
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores)], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(score), f"{fields}, `{out}` double")
