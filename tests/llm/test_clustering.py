"""Yinyang clustering against plain rounds of nearest centroids."""

from __future__ import annotations

import hashlib
from math import floor

import numpy as np
import pytest

from identity_spark.llm import clustering


def brute(rows, k, rounds, scale=64, seed=1):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        of = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(of, c, strict=True)]
    out = [(i, nearest(v), far(v, c[nearest(v)])) for i, v in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out)


@pytest.mark.parametrize(("k", "rounds", "groups", "n"), [(1, 2, 4, 9), (6, 0, 2, 40), (7, 4, 3, 120), (16, 3, 4, 10)])
def test_clusters_are_as_brute_force(spark, k, rounds, groups, n):
    r = np.random.default_rng(n)
    rows = [(i, r.normal(size=4).round(2).tolist()) for i in range(n)]
    rows += [(None, [0.5, 0.5, 0.25, -1.0]), (3, [1.0, 2.0, 3.0, 4.0]), *[(900 + i, [0.25] * 4) for i in range(5)]]
    odd = [(800, None), (801, []), (802, [1.0] * 5), (803, [1.0, None, 2.0, 3.0]), (804, [float("nan"), 0.0, 0.0, 0.0]), (805, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS id", "'clash' AS v", "0 AS cluster", "1 AS distance", "'x' AS near")
    found = clustering.cluster(df, dim=4, k=k, rounds=rounds, groups=groups)
    assert sorted((str(x["vec_id"]), *x[1:]) for x in found.collect()) == brute(rows, k, rounds)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    found = clustering.cluster(df)
    assert found.count() == 0 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2, k=1).collect()


@pytest.mark.parametrize("size", [3, 1000, clustering.MOST - 1])
def test_bounds_hold_and_leave_distances_out(size):
    r = np.random.default_rng(size)
    heart = r.integers(-size, size, (12, 8))
    v = np.clip(heart[r.integers(0, 12, 3000)] + r.integers(-max(1, size // 20), max(2, size // 20), (3000, 8)), -size, size)
    now = clustering.Centroids(v[:12].copy(), clustering.grouped(v[:12], 4), np.zeros(12, np.int64), np.zeros((12, 8), np.int64))
    near, upper, lower = clustering.first_bounds(v, now)
    change = clustering._change(v, 12, near, None)
    looked = []
    for _ in range(8):
        before, now = now, now.moved(change)
        old = near
        near, upper, lower, n = clustering.next_bounds(v, near, upper, lower, before, now)
        d = ((v[:, None, :] - now.c[None]) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all()
        assert (upper**2 >= d[np.arange(len(v)), near] - 1e-6).all()
        others = np.sqrt(d.astype(float))
        others[np.arange(len(v)), near] = np.inf
        assert all((lower[:, g] <= others[:, m].min(axis=1) + 1e-9).all() for g, m in enumerate(now.groups))
        change = clustering._change(v, 12, near, old)
        looked.append(n)
    assert looked[-1] < d.size / 2
