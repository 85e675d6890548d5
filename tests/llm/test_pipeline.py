"""The corpus pipeline and the registered queries on a small folder of tables."""

from __future__ import annotations

import re

import duckdb
import numpy as np
from brute import brute_components, brute_spans, brute_viterbi
from pyspark.sql import functions as F

import corpus_pipeline
from identity_spark.llm import pieces, queries
from identity_spark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        now = written(stage(spark, now, SF), "stage")
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == columns and len(after) == now.count()
        if name == "n-gram Jaccard join":
            component = brute_components(before, 5, 80)
            assert sorted(after) == sorted(i for i, (_, c) in component.items() if c == i)
        elif name == "secret scans":
            for i, text in before:
                assert (after[i] == text) == (not brute_spans(text)) or re.search("gh[opsur]_|xox|eyJ|AIza|BEGIN", text)
                assert not brute_spans(after[i])
        else:
            assert 0 < len(after) <= len(before) and all(after[i] == dict(before)[i] for i in after)
    v = pieces.Vocabulary(queries.vocabulary("piece_bpe_32k.model"))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert sorted(out) == sorted(texts)
    for i in np.random.default_rng(0).choice(sorted(out), 10).tolist():
        assert out[i] == brute_viterbi(v, texts[i])


def test_every_query_has_whole_results(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        out = query(spark, SF)
        if name not in ("op6_main_text", "op10_exact_top_k", "op11_yinyang_clustering"):
            assert out.count() == n, name


def odd(spark, rows):
    """Documents with columns that operators might have names for."""
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("x") for c in ("key", "print", "score", "set", "group", "n", "ids", "spans", "hash", "item_id", "toxic", "component_id", "__key", "_text")}
    return spark.createDataFrame(rows, fields).withColumns(clash)


def test_stages_of_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", None, "s", 0), (None, "no key but words enough for a shingle of five", "en", None, 3), (None, None, None, None, None), (5, "same words here for two rows that are equal", "en", "s", 9)]
    rows += [rows[-1], (7, "same words here for two rows that are equal", "en", "s", 9), (8, "password=abcdef12 " * 400, "en", "s", 1), (9, "word " * 60_000, "en", "s", 1)]
    now = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, now, SF), "odd")
        assert out.columns == now.columns, name
        now = out
    kept = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) if r["text"] is not None else (r["doc_id"] or 0, "", None) for r in now.collect())
    assert [k for k, _, _ in kept] == [0, 0, 1, 2, 5, 8, 9]
    assert kept[5][1] == "[assign] " * 400 and kept[5][2] == 9 * 400
    ids = {r["doc_id"]: r["n_ids"] for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert ids[1] == ids[2] == 0 and ids[9] >= 60_000
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), SF).count() == 0, name
    assert corpus_pipeline.secret_spans(spark, now.drop("n_chars"), SF).columns == now.drop("n_chars").columns


def test_queries_are_as_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        out = queries.QUERIES[name](spark, SF)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(out.columns), name
        want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
        row = lambda r: tuple(str(r[c]) for c in sorted(columns))
        assert sorted(map(row, want)) == sorted(row(r.asDict()) for r in out.collect()), name
