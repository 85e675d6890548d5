"""Operators of the training-data pipeline, each against a brute-force version and its edge cases."""

from __future__ import annotations

import hashlib
import re
import struct
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import brute_components, brute_spans, brute_viterbi
from pyspark.sql import functions as F

from identity_spark.llm import decontamination, jaccard, labelled_pages, licences, main_text, pieces, queries, secrets, sharding, token_files, topk, toxicity, words
from identity_spark.llm.components import components
from identity_spark.llm.memory import Memory
from identity_spark.llm.words import hashed_words

EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One  two"), (None, "null key"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "x " * 30_000), (8, "Ünï codé — ▁ 漢字 🎉")]

CLASHING = ["score", "ids", "decoded", "spans", "n_items", "set", "hash", "n", "tile", "unit", "text_crc32", "shard", "_key", "_print", "_text", "component_id", "group", "at"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "key": F.lit("clash"), "print": F.lit(0), "part": F.lit(1), **{c: F.lit("clash") for c in CLASHING}})


def empty(spark):
    return docs(spark, [])


def test_sharding_matches_its_driver_side(spark):
    rows = docs(spark, EDGE + [(i, f"t{i}") for i in range(100, 333)])
    out = sorted(sharding.shard_documents(rows, 24).collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in out] == list(range(len(out)))
    assert all((r["shard"], r["slot"]) == sharding.place(i, len(out), 24, 20_240_601) for i, r in enumerate(out))
    counts = np.bincount([r["shard"] for r in out], minlength=24)
    assert counts.max() - counts.min() <= 1
    null = next(r for r in out if r["doc_id"] == 1)
    assert (null["size"], null["text_crc32"]) == (8, 0)
    eight = next(r for r in out if r["doc_id"] == 8)
    assert (eight["size"], eight["text_crc32"]) == (len(EDGE[-1][1].encode()) + 8, zlib.crc32(EDGE[-1][1].encode()))
    assert sharding.shard_documents(empty(spark), 24).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 24, 25, 101, 997])
def test_permutation_is_one(n):
    assert len({sharding.place(i, n, 5, 3) for i in range(n)}) == n


def test_streaming_viterbi(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    v = pieces.Vocabulary(path)
    texts = [t or "" for _, t in EDGE if t is None or len(t) < 1000] + ["thethe" * 40, "  two  blanks ", "\n\n\ta"]
    ids, ends = pieces.Encoder(v).encode(pa.array(texts))
    for text, found in zip(texts, np.split(ids, ends[:-1]), strict=True):
        whole = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else ""
        stream = pieces.StreamingViterbi(v)
        streamed = [i for k in range(0, len(whole), 5) for i in stream.push(whole[k : k + 5])] + stream.finish()
        assert found.tolist() == streamed == brute_viterbi(v, text)
        assert pieces.decoded(v, streamed) == text.replace(pieces.BLANK, " ")
    rows = pieces.decode(pieces.encode(docs(spark, EDGE), path), path).collect()
    assert all(r["decoded"] == (r["text"] or "").replace(pieces.BLANK, " ") for r in rows)
    assert pieces.encode(empty(spark), path).count() == 0
    assert pieces.decoded(v, [-1, 10**9, 0, 1]) == ""


def test_many_streams_are_as_one(monkeypatch):
    v = pieces.Vocabulary(queries.vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    parts = ["hello", "thethethe", "internationalization", "aaaa", "▁▁▁", "漢字テスト", "🎉x", "zzz\n", "1234567"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(200)]
    want = [brute_viterbi(v, x) for x in texts]
    found = pieces.streams(v, [pieces.BLANK + x.replace(" ", pieces.BLANK) for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == want
    monkeypatch.setattr(pieces, "TOGETHER", 30)
    monkeypatch.setattr(pieces, "GROUP", 300)
    monkeypatch.setattr(pieces, "ALONE", 3)
    encoder = pieces.Encoder(v, remembered=50)  # so that it forgets
    for some in (texts, texts[::-1]):
        ids, ends = encoder.encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [want[texts.index(x)] for x in some]


def unigram_file(path, scores):
    """A model file of one unigram vocabulary, in the library's format."""
    field = lambda n, kind, value: bytes([n << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)
    piece = lambda x, score, kind: field(1, 2, field(1, 2, x.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    pieces_of = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3) + b"".join(piece(x, y, 1) for x, y in scores.items())
    path.write_bytes(pieces_of + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01")))
    return str(path)


def test_unigram_scores_give_the_library_s_ids(tmp_path):
    import sentencepiece

    rng = np.random.default_rng(5)
    names = ["▁", *"abc", "ab", "bc", "▁a", "abc", "▁ab", "cab", "cc", "b▁a", "bca", "aabb", "▁▁"]
    for k in range(5):
        scores = {x: -float(rng.integers(1, 4000)) / 256 for x in names}  # exact as floats and in millionths
        path = unigram_file(tmp_path / f"{k}.model", scores)
        model, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path, "file")
        texts = ["".join(rng.choice(list("abc "), rng.integers(1, 40))) for _ in range(60)]
        ids, ends = pieces.Encoder(v).encode(pa.array(texts))
        for text, found in zip(texts, np.split(ids, ends[:-1]), strict=True):
            score = lambda x: sum(v.score[i] for i in x)
            want = model.encode(text)
            assert score(found.tolist()) == score(want) and model.decode(found.tolist()) == model.decode(want)
            assert found.tolist() == brute_viterbi(v, text)


def test_memory():
    m, rng = Memory(), np.random.default_rng(6)
    held = {}
    for _ in range(30):
        new = np.setdiff1d(rng.integers(1, 1 << 62, 9000).astype(np.uint64), np.array([*held], np.uint64))
        runs = [np.arange(k % 5, dtype="<u4") + np.uint32(k) for k in range(len(new))]
        m.add(new, [x.tobytes() for x in runs])
        held |= dict(zip(new.tolist(), runs, strict=True))
    keys = np.array([*held], np.uint64)
    at = m.find(keys)
    assert all((m.ids[m.start[i] : m.start[i] + m.size[i]] == held[k]).all() and m.size[i] == len(held[k]) for i, k in zip(at.tolist(), keys.tolist(), strict=True))
    assert (m.find(np.setdiff1d(rng.integers(1, 1 << 60, 1000).astype(np.uint64), keys)) == -1).all()


def test_streaming_viterbi_forgets_what_is_settled():
    v = pieces.Vocabulary(queries.vocabulary("piece_bpe_32k.model"))
    stream = pieces.StreamingViterbi(v)
    for _ in range(300):
        stream.push("some words and some more")
    assert len(stream.text) < 6 * v.longest


def test_toxicity_learns_and_is_whole(spark):
    rng = np.random.default_rng(1)
    fill = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(fill, 80))
        if i % 3 == 0:
            words[int(rng.integers(80))] = ["blorgface", "blorgfaced", "zquark", "zquarky"][i // 3 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    table = docs(spark, rows + EDGE[:5] + [(9000, " ".join(fill) + " zquarks " + " ".join(fill))])
    model = toxicity.trained(table, spark.createDataFrame(labels + [(1, None), (99_999, 1)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table.filter("doc_id >= 10"), model).collect()}
    held = [i for i in range(10, 600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert right >= 0.9 * len(held)
    assert out[9000] >= 0.5  # a word that isn't in the sample, in a long text
    edge = toxicity.toxicity(docs(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.toxicity(empty(spark), model).count() == 0
    assert toxicity.fit(["a"], [1], (0, 1)).score([""])[0] == pytest.approx(1.0)


def test_toxicity_trains_on_whole_texts(spark):
    # one toxic word in a text of 150 windows, in windows that 100 evenly chosen ones leave out
    rng = np.random.default_rng(2)
    fill = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(300)]
    left_out = sorted(set(range(150)) - set(np.linspace(0, 149, 100).astype(int).tolist()))
    texts = []
    for i in range(500):
        words = list(rng.choice(fill, 900))
        if i % 2:
            words[6 * left_out[i % len(left_out)] + 2] = ["blorgface", "zquarky"][i // 2 % 2]
        texts.append(" ".join(words))
    scores = toxicity.fit(texts[:400], [i % 2 for i in range(400)], (200, 200)).score(texts[400:])
    assert sum((x >= 0.5) == i % 2 for i, x in enumerate(scores)) >= 90


def test_toxicity_sample_has_a_row_for_each_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {0: 20, 1: 20})
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, prior: (texts, labels, prior))
    labels = [(i, i % 2) for i in range(30) if zlib.crc32(str(i).encode()) % 5]
    hot = labels[0][0]
    rows = [(i, f"text {i}") for i in range(30)] + [(hot, f"again {k}") for k in range(500)]
    given = spark.createDataFrame(labels + [labels[0]] * 100, "doc_id long, toxic int")
    texts, classes, prior = toxicity.trained(docs(spark, rows), given)
    assert sorted(classes) == sorted(c for _, c in labels)  # no row crowds out another one's label
    assert sum(prior) == len(labels) + 100
    assert toxicity.trained(docs(spark, rows[::-1]), given) == (texts, classes, prior)


def test_decontamination_tolerates_two_substitutions(spark):
    item = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(2)
    rows = [(0, "clean words only " * 20), (1, " ".join(item)), (2, "x y z " + " ".join(item[5:18]) + " tail"), (3, " ".join(item[:10])), (4, "cut off: " + " ".join(item[:11]))]
    for k in range(60):
        window = item[9:22]
        for p in rng.choice(13, 2, replace=False):
            window[p] = "sub"
        rows.append((100 + k, "some text before. " + ", ".join(window).upper() + "! And after"))
    rows.append((200, " ".join(w if i % 4 else "sub" for i, w in enumerate(item))))  # three or more of any 13
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (10, " ".join(f"q{i}" for i in range(9)))], "item_id long, text string")
    out = {r["doc_id"]: r["n_items"] for r in decontamination.contamination(docs(spark, rows), bench).collect()}
    assert all(n == 1 for i, n in out.items() if i in (1, 2, 4) or 100 <= i < 160)
    assert out[0] == out[3] == out[200] == 0
    edge = decontamination.contamination(docs(spark, EDGE + [(77, " ".join(f"q{i}" for i in range(9)))] * 2), bench).collect()
    assert sorted(r["n_items"] for r in edge) == [0] * len(EDGE) + [1, 1]
    assert decontamination.decontaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_decontamination_finds_every_substitution_of_short_items(spark):
    bench, rows, want = [], [], {}
    for n in range(1, 14):
        item = [f"s{n}x{i}" for i in range(n)]
        bench.append((n, " ".join(item)))
        copies = [(item, True)] + [(item[:i] + ["sub"] + item[i + 1 :], n >= 8) for i in range(n)]
        copies += [(item[:i] + ["sub"] + item[i + 1 : j] + ["sub"] + item[j + 1 :], n >= 13) for i in range(n) for j in range(i + 1, n)]
        for words, found in copies:
            for text in ("before it " + " ".join(words) + " and after", " ".join(words)):
                want[len(rows)] = (int(found), n if found else None, sum(a == b for a, b in zip(words, item, strict=True)) if found else 0)
                rows.append((len(rows), text))
        for words in (item[1:], item[:-1]):
            found = n >= 8
            want[len(rows)] = (int(found), n if found else None, n - 1 if found else 0)
            rows.append((len(rows), " ".join(words)))
    want[len(rows)] = (1, 1, 1)
    rows.append((len(rows), "s1x0 " * 500))
    table = spark.createDataFrame(bench, "item_id long, text string")
    out = {r["doc_id"]: (r["n_items"], r["first_item"], r["shared_words"]) for r in decontamination.contamination(docs(spark, rows), table).collect()}
    assert out == want
    hits = decontamination.seeds(docs(spark, rows[-1:]), ["doc_id"], 0, masks=decontamination.masks_for([1]))
    assert hits.count() == 1  # an item of a common word meets a text once


def test_decontamination_is_as_brute_force(spark):
    rng = np.random.default_rng(8)
    few = [f"w{i}" for i in range(6)]  # so that words repeat and alignments overlap
    many = [f"u{i}" for i in range(300)]
    items = [(i, list(rng.choice(few if i % 3 == 0 else many, int(rng.integers(1, 41))))) for i in range(45)]
    rows = []
    for k in range(150):
        words = list(rng.choice(few if k % 4 == 0 else many, int(rng.integers(0, 30))))
        copy = list(items[int(rng.integers(len(items)))][1])
        a, b = sorted(rng.integers(0, len(copy) + 1, 2).tolist()) if k % 2 else (0, len(copy))
        for _ in range(int(rng.integers(0, 4))):
            copy[int(rng.integers(len(copy)))] = "sub"
        at = int(rng.integers(0, len(words) + 1))
        rows.append((k, words[:at] + copy[a:b] + words[at:]))

    def shared(doc, item):
        n, best = len(item), 0
        size, least = (13, 11) if n >= 13 else (n, n - 1 if n >= 8 else n)
        for shift in range(-n, len(doc) + 1):
            same = [0 <= shift + i < len(doc) and doc[shift + i] == w for i, w in enumerate(item)]
            best = max([best, *(c for i in range(n - size + 1) if (c := sum(same[i : i + size])) >= least)])
        return best

    want = {}
    for k, doc in rows:
        found = {i: c for i, item in items if (c := shared(doc, item))}
        want[k] = (len(found), min(found, default=None), max(found.values(), default=0))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    out = {r["doc_id"]: (r["n_items"], r["first_item"], r["shared_words"]) for r in decontamination.contamination(docs(spark, [(k, " ".join(x)) for k, x in rows]), bench).collect()}
    assert out == want and 20 < sum(n > 0 for n, _, _ in want.values()) < 150


def test_licences_are_as_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [t for x in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") for t in (licences.TEXTS[x], f"{x.replace('-Clause', '')} text")]
    texts += ["Licensed under the MIT License.", "Released under GNU GPL v3", "Copyright (c) 2021 Some One", "MIT License", "plain words", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."]
    rows = [(k, "\n\n".join(rng.choice(texts, int(rng.integers(1, 5))).tolist())) for k in range(60)]
    rows = [(k, t.replace("\n\n", "\n") if k % 9 == 0 and "(c)" not in t else t) for k, t in rows]
    known = licences.known(spark)
    blocks = {}
    for k, text in rows:
        parts = text.split("\n\n")
        blocks[k] = {text, *text.split("\n")} | {"\n\n".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}
    every = sorted(set().union(*blocks.values()))
    form = {r["text"]: r["c"] for r in spark.createDataFrame([(x,) for x in every], "text string").withColumn("c", licences.canonical(F.col("text"))).collect()}
    names = {r["c"]: r["x"] for r in known.groupBy(licences.canonical(F.col("text")).alias("c")).agg(F.min("licence").alias("x")).collect()}
    out = {r["doc_id"]: (r["whole_licence"], r["licences"]) for r in licences.scan(docs(spark, rows), known).collect()}
    for k, text in rows:
        assert out[k] == (names.get(form[text]), sorted({names[form[x]] for x in blocks[k] if form[x] in names})), text


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rows = [(i or 0, t) for i, t in EDGE] + [(50, "a<|endoftext|>b"), (51, "two  blanks \n and\n\n lines. wide\xa0hard"), (52, " lead, trail "), (53, "it's they'll 'quoted'"), (54, "a.b,c!?!x, \r\n \n  y\n"), (55, "wide\u3000 \u2003x . , end  ")]
    out = sorted(token_files.with_checksums(token_files.token_table(docs(spark, rows), path).withColumnRenamed("doc_id", "key")).collect(), key=lambda r: r["start"])
    encode = Tokenizer.from_file(path).encode
    at = 0
    for (_, text), r in zip(sorted(rows, key=lambda x: (x[0], zlib.crc32((x[1] or "").encode()))), out, strict=True):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_table(empty(spark), path).count() == 0


def test_token_files_layout(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.token_table(docs(spark, [(i, f"text {i}") for i in range(50)]), queries.vocabulary("byte_bpe_50k.json"), path=path)
    file = max(tmp_path.glob("tokens/*.parquet"), key=lambda p: pq.read_metadata(p).num_rows)
    column = {pq.read_metadata(file).row_group(0).column(i).path_in_schema: pq.read_metadata(file).row_group(0).column(i) for i in range(5)}
    assert "DELTA_BINARY_PACKED" in column["key"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in column.values())


def test_token_files_are_read_in_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROW_GROUP_BYTES", 1 << 16)
    path = f"file://{tmp_path}/tokens"
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 200))) for i in range(3000)]
    token_files.token_table(docs(spark, rows), queries.vocabulary("byte_bpe_50k.json"), path=path)
    files = [pq.ParquetFile(p) for p in tmp_path.glob("tokens/*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert len(groups) > 8 and max(g.num_rows for g in groups) < 1500
    lists = [g.column(4) for g in groups]
    assert all({"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings) for c in lists)
    part = token_files.read_tokens(spark, path, keys=(100, 140))
    assert {r["key"]: r["n_tokens"] for r in part.collect()} == {r["key"]: r["n_tokens"] for r in token_files.read_tokens(spark, path).filter("key BETWEEN 100 AND 140").collect()}
    plan = part.select("key", "n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,100), LessThanOrEqual(key,140)" in plan and "ids:array" not in plan.split("== Physical Plan ==")[1]


def test_top_k_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    rows = spark.createDataFrame([(0, [1.0, 0.0])] + [(5, [1.0, 1.0])] * 400 + [(3, [1.0, 2.0])], "id long, v array<double>")
    packed = topk.packed(rows, 16, 2)
    assert max(r["n"] for r in packed.select(F.size("ids").alias("n")).collect()) < 60
    out = [(r["rank"], r["id"]) for r in topk.top_k(rows.filter("id = 0"), rows, 4).collect()]
    assert sorted(out) == [(1, 3), (2, 5), (3, 5), (4, 5)]


def test_top_k_sends_queries_to_as_many_places_as_cores_ask_for(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(size=(600, 5)) * 64) / 64
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "id long, v array<double>").cache()
    s = (vectors * 1024 @ (vectors * 1024).T).astype(int)
    want = {(q, n + 1): (i, s[q, i]) for q in range(0, 600, 10) for n, i in enumerate(sorted((i for i in range(600) if i != q), key=lambda i: (-s[q, i], i))[:3])}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        found = topk.top_k(rows.filter("id % 10 = 0"), rows, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and not re.search(r"BroadcastExchange[^\n]*\n[^\n]*flat", plan)  # repeated blocks have no known size
        assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found.collect()} == want
        q, x = (topk.packed(df.select("id", F.transform("v", lambda c: c.cast("long")).alias("v")), b, i) for i, (df, b) in enumerate([(rows.filter("id % 10 = 0"), 8), (rows, 16)]))
        n_q, n_x = q.count(), x.count()
        for held in (1 << 20, 1):  # one byte: each block of queries is a group
            monkeypatch.setattr(topk, "HELD", held)
            groups = topk.dealt(q, x, 3)
            tiles = topk.tiled(x, q, groups).select("q_group", "x_group", "side", "part").cache()
            assert groups[0] * groups[1] <= max(n_q, topk.TILES * spark.sparkContext.defaultParallelism) and (held > 1 or groups[0] == n_q)
            assert tiles.filter("side = 0").count() == n_q * groups[1] and tiles.filter("side = 1").count() == n_x * groups[0]
            pairs = tiles.filter("side = 0").alias("q").join(tiles.filter("side = 1").alias("x"), ["q_group", "x_group"]).select(F.col("q.part").alias("a"), F.col("x.part").alias("b"))
            assert pairs.count() == pairs.distinct().count() == n_q * n_x
        again = topk.top_k(rows.filter("id % 10 = 0"), rows, 3)
        assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in again.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_of_scores_beyond_doubles(spark):
    rows = spark.createDataFrame([(0, [1024.0]), (1, [0.0]), (2, [2.0**24])], "id long, v array<double>")
    assert [tuple(r) for r in topk.top_k(rows.filter("id = 0"), rows, 1).collect()] == [(0, 1, 2, 2**54)]


def test_main_text_model():
    model = main_text.fit(labelled_pages.pages(160))
    tests = labelled_pages.pages(60, seed=99)
    right = total = 0
    for page in tests:
        tree = main_text.read(page)
        label = []
        for name, parent in zip(tree.attributes, tree.parent, strict=True):
            label.append(1 if "data-main=1" in name else 0 if "data-main=0" in name or parent < 0 else label[parent])
        p, _ = main_text.marginals(main_text.forest([tree]), model)
        right += int(((p >= 0.5) == np.array(label)).sum())
        total += len(label)
    assert right >= 0.97 * total
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First\n  part.<br>Next <b>bold</b>word &#233;.<p>Open</article><footer>&copy; x</footer>'
    assert main_text.main_texts([page, "", "<<<>", "plain"], model)[:2] == ["A & B First part. Next boldword é. Open", ""]


def test_html_in_odd_forms():
    model = main_text.fit(labelled_pages.pages(160))
    start, end = "<article><h1>A title of the page</h1><p>", "</p><p>Another paragraph of the article, with words enough. It ends here.</p></article>"
    cases = {
        "<b title='it's'>first</b> and more text of it.": "first and more text of it.",
        'a formula <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in it.': "a formula E=m in it.",
        "long<wbr>word, pic<img src=a>ture, <custom-tag>own</custom-tag>tag.": "longword, picture, owntag.",
        "<object data=x>text in place of it</object> stays.": "text in place of it stays.",
        "<noscript>no text<p>is lost, as nothing ends it.": "no text is lost, as nothing ends it.",
        'Words of a <a href="x>y" b = c d>link</a> stay here, <i title="no end>and on it goes.': "Words of a link stay here, and on it goes.",
    }
    for given, want in cases.items():
        text = main_text.main_texts([start + given + end], model)[0]
        assert text == f"A title of the page {want} Another paragraph of the article, with words enough. It ends here.", given


def test_main_text_of_the_given_pages():
    import html
    import re

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found = main_text.main_texts(pages, main_text.fit(labelled_pages.pages()))
    for page, text in zip(pages, found, strict=True):
        article = re.search("<article.*?</article>", page, re.DOTALL)
        assert text == " ".join(html.unescape(re.sub("<[^>]+>", " ", article[0])).split())


def test_main_text_messages_are_exact():
    rng = np.random.default_rng(0)
    f = main_text.forest([main_text.read("<div><p>a</p><ul><li>b<a href=x>c</a></li></ul></div>")])
    m = main_text.Model(rng.normal(size=main_text.N_FEATURES), rng.normal(size=(3, 2, 2)))
    n = len(f.parent)
    weight = np.zeros((2,) * n)
    for states in np.ndindex(*weight.shape):
        weight[states] = np.exp(sum(s * float(x @ m.weight) for s, x in zip(states, f.features, strict=True)) + sum(m.pair[f.kind[i], states[f.parent[i]], states[i]] for i in range(n) if f.parent[i] >= 0))
    brute = [weight[(slice(None),) * i + (1,)].sum() / weight.sum() for i in range(n)]
    np.testing.assert_allclose(main_text.marginals(f, m)[0], brute, rtol=1e-9)


def test_main_text_rows(spark):
    model = main_text.fit(labelled_pages.pages(40))
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p>x"), (3, "v", "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = main_text.extract(pages, model)
    assert out.count() == 4 and out.columns == ["page_id", "url", "text"]
    assert main_text.extract(pages.limit(0), model).count() == 0


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace('"', "“"), "intro\n\n" + mit.replace("\n\n", " ") + "\n\nmore", "x\nReleased under the MIT Licence\ny", "mit license is mentioned here", "Licensed under CC BY-NC 4.0."]
    out = {r["doc_id"]: r for r in licences.scan(docs(spark, EDGE + [(100 + i, t) for i, t in enumerate(texts)] + [(103, texts[3])]), licences.known(spark)).collect()}
    assert out[100]["whole_licence"] == out[101]["whole_licence"] == "MIT"
    assert [out[102]["whole_licence"], out[102]["licences"]] == [None, ["MIT"]]
    assert (out[103]["licences"], out[103]["n_places"]) == (["MIT"], 1)
    assert out[104]["licences"] == [] and out[105]["licences"] == ["CC-BY-NC-4.0"]
    assert all(out[i]["licences"] == [] for i in range(1, 9))
    assert licences.scan(empty(spark), licences.known(spark)).count() == 0


def test_licences_in_full(spark):
    texts = licences.published()
    assert {x for x, _ in texts} == {"Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    line = "Copyright (c) 2020 Someone\n\n"
    texts += [(x, f"{title}\n\n{line}{licences.TEXTS[x]}") for x, title in [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License")]]
    for licence, text in licences.published():
        end = {"Apache-2.0": "APPENDIX: How to", "GPL-2.0": "How to Apply", "GPL-3.0": "How to Apply"}.get(licence)
        texts += [(licence, text.strip().split("\n", 1)[1])] if licence in ("MPL-2.0", "CC-BY-SA-4.0") else [(licence, text[: text.index(end)])] if end else []
    out = {r["doc_id"]: r["whole_licence"] for r in licences.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(texts)]), licences.known(spark)).collect()}
    assert out == {i: x for i, (x, _) in enumerate(texts)}
    # the same in a document of more text, once or twice
    inside = [(x, f"A readme of some words.\n\n{t}\n\nMore words after it.") for x, t in texts] + [("MIT", "\n\nand\n\n".join(t for x, t in texts if x == "MIT"))]
    out = {r["doc_id"]: r for r in licences.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(inside)]), licences.known(spark)).collect()}
    assert [i for i, (x, _) in enumerate(inside) if x not in out[i]["licences"] or out[i]["whole_licence"] is not None] == []


def test_licences_in_any_wrapping(spark):
    # the terms alone, as a notice that runs on into other lines is one line no more
    terms = [(x, t[t.index(licences.STARTS[x][-1]) : t.index(licences.ENDS[x][-1])]) for x, t in licences.published() if x in ("Apache-2.0", "GPL-2.0", "MPL-2.0")]
    texts = [(x, "\n\n".join(textwrap.fill(part, width, break_long_words=False, break_on_hyphens=False) for part in t.split("\n\n"))) for x in ("ISC", "MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Unlicense") for width in range(20, 90) for t in [licences.TEXTS[x]]]
    texts += [(x, "\n\n".join(textwrap.fill(part, width, break_long_words=False, break_on_hyphens=False) for part in t.split("\n\n"))) for x, t in terms for width in (60, 66, 72)]
    assert any("\ncopyright notice" in t for _, t in texts) and any("\nCOPYRIGHT HOLDERS" in t for _, t in texts) and any("\nCOPYRIGHT OWNER" in t or "copyright\nowner" in t for _, t in texts)
    notices = ["Copyright (c) 2020 Someone", "# (C) 2019-2020 Some One", "© Some One", "Copyright 2020 Some One. All rights reserved.", "COPYRIGHT BY SOME ONE", "Copyright Some One, Inc. and other contributors", "Copyright the Some One Authors", "Copyright [yyyy] [name of copyright owner]", "(c) Some One", "All rights reserved."]
    texts += [("ISC", f"{n}\n\n{licences.TEXTS['ISC']}") for n in notices]
    out = {r["doc_id"]: r["whole_licence"] for r in licences.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(texts)]), licences.known(spark)).collect()}
    assert [(x, t) for i, (x, t) in enumerate(texts) if out[i] != x] == []


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_jaccard_join_is_exact(spark, monkeypatch, size, percent, seed):
    monkeypatch.setattr(jaccard, "TILE", 8)  # so that tiles are cut into blocks
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = list(rng.choice(vocabulary, 40))
    rows = [(i, t) for i, t in EDGE if i in (1, 2, 3, 4, 5, 8)] + [(9, "one"), (10, "ONE"), (11, "a b c d e f g h"), (12, "a b c d e f g h")]
    for g in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 120)))) + (passage if g % 2 else [])
        for k in range(int(rng.integers(1, 14))):
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            rows.append((1000 + 100 * g + k, " ".join(words)))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs(spark, rows), size=size, percent=percent).collect()}
    assert out == brute_components(rows, size, percent)


def test_sets_of_one_digest_are_told_apart(spark, monkeypatch):
    whole = jaccard.digests
    monkeypatch.setattr(jaccard, "digests", lambda s: (whole(s)[0] % 3, whole(s)[1]))
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice([f"v{k}" for k in range(60)], 30))) for i in range(12)]
    rows += [(20, rows[0][1] + " tail"), (21, rows[0][1]), (22, rows[5][1] + " end")]
    assert len(jaccard.renamed(jaccard.signatures(docs(spark, rows), "doc_id", "text", 4))) >= 9
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs(spark, rows), size=4, percent=85).collect()}
    assert out == brute_components(rows, 4, 85)


def test_near_copies_leave_one(spark):
    rows = EDGE + [(20, "p q r s t u v w x y z"), (21, "p q r s t u v w x y z"), (22, "lone text of some words here")]
    out = jaccard.without_near_copies(docs(spark, rows), size=5, percent=80)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert [i for none, i in kept if not none] == [1, 2, 3, 4, 5, 6, 7, 8, 20, 22] and kept[-1][0]
    assert out.columns == docs(spark, []).columns
    assert jaccard.without_near_copies(empty(spark), size=5, percent=80).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (7, 3)] + [(100 + i, 101 + i) for i in range(30)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 131)}


SECRETS = ["", "password=abc secret: tokenx_12345", 'api_key = "ABCdef123" API-KEY=1234567', "secret=token:abcdefgh", "AKIA" + "A" * 16 + " xAKIAAKIA" + "B" * 20, "f" * 24 + "g" + "0" * 23, "ſecret=abcdefgh", "é" * 5 + "PassWD:'hunter22' " + "deadbeef" * 4, "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "🎉 token==abc=def/ghi"]


def test_secrets(spark):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(SECRETS)] + [(101, SECRETS[1])]
    out = secrets.find_secrets(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [tuple(x) for x in r["spans"] if x["order"] < 3] == brute_spans(r["text"] or "")
    kinds = {r["doc_id"]: {x["kind"] for x in r["spans"]} for r in out}
    assert "github" in kinds[108] and kinds[109] == {"pem"}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs(spark, rows)).collect()}
    assert clean[107] == "é" * 5 + "[assign]' [hex]" and clean[1] is None and clean[4] == "one"
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_many_secrets_in_a_text(spark):
    rows = [(1, " ".join(f"é password=abcdef{i:03d};" for i in range(700))), (2, " ".join(f"token=ab{i % 10}" + "c" * (i % 7) for i in range(513)))]
    out = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in secrets.find_secrets(docs(spark, rows)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs(spark, rows)).collect()}
    for i, text in rows:
        spans = brute_spans(text)
        assert out[i] == spans
        at, want = 0, ""
        for start, _, kind, end in spans:
            at, want = end, want + text[at:start] + f"[{kind}]"
        assert clean[i] == want + text[at:]


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("ab") == []
    assert secrets.trigram_query("abcd?e") == [frozenset({frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bce"})})]
    assert len(secrets.trigram_query("abc.*(?:xyz|uvw)")) == 2


def test_secret_digest(spark):
    spans = secrets.find_secrets(docs(spark, [(1, SECRETS[1])])).select(F.sha2(secrets.joined(F.col("spans")), 256).alias("d")).first()["d"]
    assert spans == hashlib.sha256(b"assign:13:33").hexdigest()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_k(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BINS", 4)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    rng = np.random.default_rng(k)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 190)] + [(200, None), (300, [float("nan")] * 6), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (500, []), (501, [float("inf")] * 6)]
    rows = spark.createDataFrame(vectors, "id long, v array<float>")
    out = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(rows.filter("id % 10 = 0"), rows, k).collect()}
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in whole if i % 10 == 0]:
        near = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(near[:k])}
    assert out == want
    assert topk.top_k(rows.limit(0), rows.limit(0), k).count() == 0


def test_words_end_where_rows_end():
    data = "ab cdEF  g".encode()
    hashes, before = hashed_words(np.frombuffer(data, np.uint8), np.array([0, 4, 4, 10]))
    assert before.tolist() == [0, 2, 2, 4] and len(set(hashes.tolist())) == 4  # "ab", "c" | | "dEF", "g"
    assert hashed_words(np.frombuffer(b"EF ef", np.uint8), np.array([0, 5]))[0].tolist() == [hashed_words(np.frombuffer(b"ef", np.uint8), np.array([0, 2]))[0][0]] * 2


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.frombuffer(" ".join("".join(rng.choice(list("abCD"), rng.integers(1, 30))) for _ in range(500)).encode(), np.uint8)
    whole = hashed_words(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(words, "PIECE_BYTES", 40)
    words._usual_powers.cache_clear()
    try:
        assert (hashed_words(data, np.array([0, len(data)]))[0] == whole).all()
    finally:
        words._usual_powers.cache_clear()


def thue_morse(n):
    """Two words of n letters whose polynomials are equal modulo 2**64, whatever odd base they have."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_long_words_of_equal_polynomials_are_told_apart(spark, n):
    a, b = thue_morse(n)
    h, _ = hashed_words(np.frombuffer(f"{a} {b} {a}".encode(), np.uint8), np.array([0, 3 * n + 2]))
    assert h[0] == h[2] != h[1]
    rows = docs(spark, [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, a), (4, b)])
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(rows.select("doc_id", "text"), size=4, percent=85).collect()}
    assert linked == {i: i for i in (1, 2, 3, 4)}
    items = spark.createDataFrame([(1, a)], "item_id int, text string")
    found = {r["doc_id"] for r in decontamination.contamination(rows, items).filter("n_items > 0").collect()}
    assert found == {1, 3}
    together = rows.coalesce(1)
    decoded = pieces.encode(together.select("doc_id", "text"), queries.vocabulary("piece_bpe_32k.model"), back="decoded")
    assert decoded.filter("text <> decoded").count() == 0
    path = queries.vocabulary("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for text, ids in zip((a, b), np.split(*(lambda x: (x[0], x[1][:-1]))(token_files.encoder(path).encode(pa.array([a, b])))), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
