"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np

from identity_spark.llm import resampling
from identity_spark.llm.words import PIECE_BYTES


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        rows.append([i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None, len(w) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def made(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.selectExpr("*", "'clash' AS key", "'clash' AS row", "0 AS score", "1 AS rank", "'x' AS stream", "2 AS weight", "3 AS place", "4 AS n_features")


def test_resampling_is_as_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["The", "café", "a", "of", "漢字", "x1", "Maße", "l" * 300, "0", "e-mail", "don't", "İ", "a b", "\U0001f389"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,.;\n\t"), (203, "one"), (204, "Two  words"), (None, "null key " * 30), (7, docs[7][1]), (7, docs[7][1]), (300, "Big " * (PIECE_BYTES // 3) + "end"), (301, "y" * (PIECE_BYTES + 10))]
    target = ["the café of a", None, "", "x1 0 x1 0"]
    wanted = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id int, text string, key string")
    for buckets, percent, least in ((97, 30, 20), (10_000, 5, 3), (65_536, 100, 1)):
        found = resampling.resample(made(spark, docs), wanted, percent=percent, buckets=buckets, least_words=least)
        assert Counter(tuple(x) for x in found.collect()) == brute(docs, target, buckets, percent, least, 42)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert resampling.resample(made(spark, []), none).count() == 0
    docs = [(1, "a b c"), (2, None)]
    assert Counter(tuple(x) for x in resampling.resample(made(spark, docs), none).collect()) == brute(docs, [], 10_000, 5, 20, 42)


def test_runs_of_words_by_combining():
    r = random.Random(1)
    words = [bytes(r.choices(range(256), k=r.choice([1, 3, 9, 40, 700]))) for _ in range(200)]
    crc, n = resampling.features(*resampling._numbers(words), np.repeat([0, 1], 100))
    assert crc.tolist() == [zlib.crc32(b" ".join(words[i - k : i + 1])) for d in (0, 100) for i in range(d, d + 100) for k in range(3) if i - k >= d]
    assert n.sum() == len(crc)
