"""Similarity with products left out against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from identity_spark.operators import match


def made(spark, n_ids, entries, dim, noise, seed):
    """Galleries of two cameras: identities with near entries, one with many, odd vectors; queries near some of them."""
    r = np.random.default_rng(seed)
    hearts = r.normal(size=(n_ids, dim))
    rows = [(c, g, g * 100 + k, (hearts[g] + noise * r.normal(size=dim)).tolist()) for c in (0, 1) for g in range(n_ids) for k in range(entries if g else 12 * entries)]
    rows += [(0, 900, 1, [1.0, 2.0]), (0, 901, 2, None), (0, 902, 3, [float(x) for x in -hearts[1]]), (0, 902, 4, hearts[1].tolist())]
    asked = [(c, f"q{c}-{k}", (hearts[k % n_ids] + 2 * noise * r.normal(size=dim)).tolist()) for c in (0, 1, 2) for k in range(60)]
    asked += [(0, "null", None), (0, "zero", [0.0] * dim), (0, "short", [2.0, 4.1])]
    return spark.createDataFrame(asked, "camera_id long, query_id string, embedding array<double>"), spark.createDataFrame(rows, "camera_id long, global_id long, entry_seq long, embedding array<double>")


def found(df):
    return {(r["camera_id"], r["query_id"], r["global_id"]): (round(r["score"], 9), r["first_seq"]) for r in df.collect()}


@pytest.mark.parametrize(("least", "noise", "pivot_from"), [(0.82, 0.1, 10**9), (0.82, 0.1, 1), (0.64, 0.3, 1), (0.0, 0.2, 1), (-0.5, 0.2, 10**9), (0.999, 0.02, 1)])
def test_what_angles_leave_out_has_no_score(spark, monkeypatch, least, noise, pivot_from):
    monkeypatch.setattr(match, "BLOCK", 32)
    queries, gallery = made(spark, 40, 5, 16, noise, 3)
    every = {k: v for k, v in found(match.all_top1_sims(queries, gallery)).items() if v[0] >= least}
    some = found(match.all_top1_sims(queries, gallery, least=least, pivot_from=pivot_from))
    assert {k: v for k, v in some.items() if v[0] >= least} == every and every


def test_most_products_are_spared(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 64)
    queries, gallery = made(spark, 60, 8, 32, 0.05, 5)
    usual, clustered = ({r["camera_id"]: (r["pairs"], r["made"]) for r in match.products_made(queries, gallery, 0.82, pivot_from=p).collect()} for p in (10**9, 1))
    for part in (usual, clustered):
        assert part[1][0] == 60 * (59 * 8 + 96)
        assert all(made < pairs / 3 for pairs, made in part.values())
    assert sum(m for _, m in clustered.values()) <= sum(m for _, m in usual.values()) * 1.5


def test_a_zero_entry_is_a_candidate_of_no_direction(spark):
    gallery = spark.createDataFrame([(0, 1, 1, [0.0, 0.0]), (0, 1, 2, [1.0, 0.1]), (0, 2, 3, [0.0, 0.0])], "camera_id long, global_id long, entry_seq long, embedding array<double>")
    queries = spark.createDataFrame([(0, "a", [1.0, 0.0])], "camera_id long, query_id string, embedding array<double>")
    assert list(found(match.all_top1_sims(queries, gallery, least=0.5))) == [(0, "a", 1)]
    assert match.all_top1_sims(queries, gallery.filter("global_id > 5"), least=0.5).count() == 0


def test_pivots(spark):
    rows = spark.createDataFrame([(0, 1, [2.0, 0.1]), (0, 2, [0.0, 1.0]), (0, 3, [1.0])], "camera_id long, global_id long, v array<double>")
    assert {r["global_id"]: r["pivot"] for r in match.with_pivots(rows, "v", np.array([[1.0, 0.0], [0.0, 3.0]])).collect()} == {1: 0, 2: 1, 3: -1}
    assert match.with_pivots(rows.filter(F.lit(False)), "v", np.eye(2)).count() == 0


def test_older_identities_take_half_of_the_products(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 32)
    _, gallery = made(spark, 320, 2, 16, 0.1, 7)
    c = match.centroids(gallery.filter("global_id < 900")).cache()
    asked = c.withColumnRenamed("global_id", "source")
    every = {k: v for k, v in {(r["camera_id"], r["source"], r["global_id"]): round(r["score"], 9) for r in match.all_top1_sims(asked, c, query="source").collect()}.items() if k[2] < k[1] and v >= 0.5}
    half = {(r["camera_id"], r["source"], r["global_id"]): round(r["score"], 9) for r in match.all_top1_sims(asked, c, query="source", least=0.5, older=True).collect()}
    assert {k: v for k, v in half.items() if v >= 0.5} == every and every
    rows = match.products_made(asked, c, -1.0, query="source", older=True).collect()
    assert all(r["made"] <= 0.56 * r["pairs"] for r in rows)


def test_own_entries_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 32)
    queries, gallery = made(spark, 12, 5, 16, 0.2, 11)
    odd = spark.createDataFrame([(0, 950, 1, []), (0, 951, 2, [None] * 16)], gallery.schema)
    gallery = gallery.unionByName(odd)
    asked = queries.crossJoin(gallery.select("global_id").distinct().filter("global_id in (0, 1, 7, 900, 901, 902, 950, 951)"))
    asked = asked.unionByName(spark.createDataFrame([(0, "empty", [], 950)], asked.schema))
    every = {k: v for k, (v, _) in found(match.all_top1_sims(queries, gallery.filter("global_id < 950"))).items()}
    own = {(r["camera_id"], r["query_id"], r["global_id"]): round(r["score"], 9) for r in match.own_sims(asked, gallery).collect()}
    assert own == {k: v for k, v in every.items() if k[2] in (0, 1, 7, 900, 902)} | {(0, "empty", 950): 0.0}
    filled = {(r["camera_id"], r["query_id"], r["global_id"]): round(r["score"], 9) for r in match.top1_sim(asked, gallery).collect()}
    assert len(filled) == asked.count() and all(v == own.get(k, 0.0) for k, v in filled.items())


def test_a_block_is_sent_to_few_tiles(spark, monkeypatch):
    """However many blocks there are, a block is sent to the root of the number of tiles, and a tile holds a bounded part."""
    monkeypatch.setattr(match, "TILES", 4)
    cores = spark.sparkContext.defaultParallelism
    one = lambda n: spark.range(n).select(F.lit(0).cast("long").alias("camera_id"), F.lit(8).alias("dim"), F.col("id").alias("part"))
    sizes = lambda n: spark.createDataFrame([(0, 8, n)], "camera_id long, dim int, parts long")
    for held, most in ((match.HELD, 4), (7 * 8 * 8 * match.BLOCK, 58)):  # of 400 blocks, 7 fit
        monkeypatch.setattr(match, "HELD", held)
        tiles = match._tiles(one(300), sizes(300), one(400), sizes(400), ["camera_id", "dim"], F.col("part")).groupBy("_a", "_b").agg(F.sum(1 - F.col("_side")).alias("g"), F.sum("_side").alias("q"))
        rows = tiles.collect()
        assert sum(r["g"] * r["q"] for r in rows) == 300 * 400
        assert len({r["_b"] for r in rows}) <= max(most, round((4 * cores * 4 / 3) ** 0.5) + 1)
        assert all(r["g"] * 8 * 8 * match.BLOCK <= held for r in rows)
