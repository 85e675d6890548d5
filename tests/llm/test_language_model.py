"""Deleted interpolation against a plain version with exact n-grams."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from identity_spark.llm import language_model as lm
from identity_spark.llm.words import PIECE_BYTES


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), 0]


def part(key):
    return None if key is None else zlib.crc32(str(key).encode()) % 7


def grams(t, n):
    padded = [1] * (n - 1) + t
    return [tuple(padded[i : i + n]) for i in range(len(t))]


class Plain:
    """Counts of some texts by order, and their estimates."""

    def __init__(self, texts):
        self.c = [Counter(g for t in texts for g in grams(t, n + 1)) for n in range(lm.ORDER)]
        self.n, self.texts = sum(self.c[0].values()), len(texts)

    def estimates(self, t):
        out = []
        for i in range(len(t)):
            f, kind = [], 0
            for n in range(lm.ORDER):
                g = grams(t, n + 1)[i]
                context = self.n if n == 0 else self.texts if i == 0 else self.c[n - 1][grams(t, n)[i - 1]]
                f.append(self.c[n][g] / context if context else 0.0)
                if n:
                    kind = kind * (len(lm.CLASSES) + 1) + sum(context >= c for c in lm.CLASSES)
            out.append((kind, f))
        return out


def brute(docs):
    train = [tokens(x) for i, x in docs if part(i) != 2]
    left, full = Plain([tokens(x) for i, x in docs if part(i) not in (2, lm.DELETED_PART)]), Plain(train)
    deleted = [e for i, x in docs if part(i) == lm.DELETED_PART for e in left.estimates(tokens(x))]
    kinds, f = np.array([k for k, _ in deleted], int), np.array([f for _, f in deleted]).reshape(-1, lm.ORDER)
    w = lm.mixture(kinds, f, np.ones(len(kinds)), len(left.c[0]))
    out = []
    for i, x in docs:
        t = tokens(x)
        score = sum(log10(w[k][0] / (len(full.c[0]) + 1) + sum(a * b for a, b in zip(w[k][1:], f, strict=True))) for k, f in full.estimates(t))
        base = sum(log10((full.c[0][(y,)] + 1) / (full.n + len(full.c[0]) + 1)) for y in t)
        out.append((i, part(i) == 2, len(t), sum(full.c[0][(y,)] > 0 for y in t), full.n, base, score))
    return sorted(out, key=str)


def check(spark, docs, within):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS key", "'clash' AS row", "0 AS score", "'x' AS block", "2 AS role", "3 AS part", "4 AS n", "true AS cut")
    found = sorted((tuple(r) for r in lm.score_texts(df).collect()), key=str)
    for a, b in zip(found, brute(docs), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=within)
    return found


def made(n, seed):
    r = random.Random(seed)
    vocabulary = ["The", "the", "café", "a", "of", "漢字", "x1,", "Maße", "l" * 300, "0", "don't", "\U0001f389"] + [f"w{k}" for k in range(40)]
    return [(i, r.choice(" \t\n").join(r.choices(vocabulary, range(52, 0, -1), k=r.randrange(0, 40)))) for i in range(n)]


def test_scores_are_as_brute_force(spark):
    docs = made(200, 3)
    docs += [(300, None), (301, ""), (302, " \n"), (None, "null key of the a"), (7, docs[7][1]), (7, docs[7][1]), *[(k, "copied text of the café") for k in range(400, 480)]]
    # the histogram's steps have the mean of their logarithms
    check(spark, docs, 2e-3)


def test_few_texts(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if part(i) == 2)
    check(spark, [(held, "a b c"), (held, None)], 1e-9)
    learnt = next(i for i in range(100) if part(i) == 0)
    check(spark, [(held, "a b c"), (learnt, "a b"), (learnt, "b c a")], 1e-9)


def test_long_texts_go_over_blocks(spark, monkeypatch):
    r = random.Random(2)
    long = " ".join(r.choices(["a", "b", "of the", "w"], k=PIECE_BYTES))
    few = [(i, t) for i, t in made(30, 4)]
    ids = [next(i for i in range(1000, 2000) if part(i) == p) for p in (0, 2, lm.DELETED_PART)]
    docs = [*few, *[(i, long + f" x{i}") for i in ids], (5000, "y" * (PIECE_BYTES + 3) + " of the a b")]
    whole = sorted((tuple(x) for x in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 100_000)
    cut = sorted((tuple(x) for x in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    for a, b in zip(whole, cut, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for (i, held, n, known, *_), (j, text) in zip(cut, sorted(docs, key=lambda d: str((d[0],))), strict=True):
        assert (i, held, n) == (j, part(j) == 2, len(tokens(text)))


def test_packed_numbers():
    r = np.random.default_rng(1)
    given = [np.zeros(0, np.int64), r.integers(0, 200, 1000), r.integers(0, 2**63, 77).astype(np.uint64) * np.uint64(2), np.array([0])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(given, lm.unpacked(lm.packed(*given)), strict=True))


def test_scores_tell_order(spark):
    docs = [(i, "the cat sat on the mat and the dog ran to the door") for i in range(60)]
    held = [i for i in range(100, 200) if part(i) == 2][:2]
    docs += [(held[0], docs[0][1]), (held[1], " ".join(reversed(docs[0][1].split())))]
    score = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert score[held[0]]["score"] > score[held[1]]["score"] + 5
    assert score[held[0]]["base_score"] == pytest.approx(score[held[1]]["base_score"])
