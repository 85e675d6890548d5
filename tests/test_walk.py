"""Folds by key: rows of a key in pieces, nulls, and vectors of any length."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from identity_spark.operators.walk import folded


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_keys_come_in_any_pieces(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    rows = [(k % 3 if k % 5 else None, "ab"[k % 2], k, [float(k)] * (k % 4) if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "a long, b string, n long, v array<double>")

    def step(state, r, ends):
        state += zip(r.values("n"), r.vectors("v"), strict=True)
        return [([n for n, _ in state], sum(0 if v is None else len(v) for _, v in state), float(r.numbers("n").sum()))] if ends else []

    out = folded(df.repartition(5), ["a", "b"], ["n"], list, step, "ns array<long>, length long, none double").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = {}
    for a, b, n, v in rows:
        want.setdefault((a, b), []).append((n, v))
    assert {(r["a"], r["b"]): (r["ns"], r["length"]) for r in out} == {k: ([n for n, _ in x], sum(len(v or []) for _, v in x)) for k, x in want.items()}
    assert len(out) == len(want) and all(r["none"] == 0 for r in out)
    assert folded(df.filter(F.lit(False)), ["a", "b"], ["n"], list, step, "ns array<long>, length long, none double").count() == 0


def test_a_long_camera_goes_in_segments(spark, monkeypatch):
    """Rows of a camera above SEGMENT: no task has many more of them, and the results are those of one walk."""
    from identity_spark.jobs import queries
    from identity_spark.jobs.fixtures import Views
    from identity_spark.operators import identify

    seen = queries.observations(Views(spark, "/root/testdata/sf0.001")).cache()
    want = sorted(map(repr, identify.identify(seen).collect()))
    most, walked = [], identify.walked
    monkeypatch.setattr(identify, "walked", lambda df, *a: (most.append(df.groupBy("camera_id").count().agg(F.max("count")).first()[0]), walked(df, *a))[1])
    monkeypatch.setattr(identify, "SEGMENT", 100, raising=False)
    assert sorted(map(repr, identify.identify(seen).collect())) == want and len(want) > 300
    assert len(most) > 2 and max(most) <= 130
