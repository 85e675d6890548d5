"""Folds over sorted rows of a key: a partition streams through, and only the key's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType


class Rows:
    """Some rows of a key in order, by column."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __len__(self) -> int:
        return self.batch.num_rows

    def numbers(self, name: str) -> np.ndarray:
        """Nulls are NaN."""
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def values(self, name: str) -> list:
        return self.batch.column(name).to_pylist()

    def vectors(self, name: str) -> list[np.ndarray | None]:
        """Views of one array, as the rows' lists stand in it."""
        column = self.batch.column(name)
        flat = column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
        ends = column.offsets.to_numpy()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there.tolist(), strict=True)]


def folded(df: DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Rows, bool], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``step(state, rows, ends)`` gives for the rows of each key in order, with the key put first.

    A key's rows come as they stand in the batches, in one piece or in several; ends is true once, with or after the last
    of them. So no more than the state is held of a key, whatever its size. schema: the columns of step's tuples."""
    types = dict(df.dtypes)
    whole = ", ".join([f"{k} {types[k]}" for k in key] + [schema])
    arrow = to_arrow_schema(DataType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Any = None
        none: pa.RecordBatch | None = None

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            none = batch.slice(0, 0)
            keys = [batch.column(k) for k in key]
            new = np.zeros(batch.num_rows, bool)
            for c in keys:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = tuple(c[a].as_py() for c in keys)
                if own != now:
                    if now is not None:
                        out += [(*now, *x) for x in step(state, Rows(none), True)]
                    now, state = own, start()
                out += [(*own, *x) for x in step(state, Rows(batch.slice(a, b - a)), False)]
            if out:
                yield made(out)
        if now is not None:
            out = [(*now, *x) for x in step(state, Rows(none), True)]
            if out:
                yield made(out)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, whole)


def walked(df: DataFrame, key: list[str], order: list[str], unit: list[str], start: Callable[[], Any], step: Callable[[Any, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``step`` gives for each unit (rows equal in key and unit) in order, with the state of its key.

    schema: the columns of step's tuples; a tuple has no key, which is put first."""
    names = df.columns
    types = dict(df.dtypes)
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Any = None
        now: tuple | None = None
        at: tuple | None = None
        rows: list[dict] = []

        def close(out: list[tuple]) -> None:
            nonlocal state, now
            if rows:
                own = at[: len(key)]
                if own != now:
                    state, now = start(), own
                out.extend(own + tuple(x) for x in step(state, rows))

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                mark = tuple(row[c] for c in key + unit)
                if mark != at:
                    close(out)
                    at, rows = mark, []
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=key + columns)
        out = []
        close(out)
        if out:
            yield pd.DataFrame(out, columns=key + columns)

    dealt = df.select(*names).repartition(*key).sortWithinPartitions(*key, *order)
    return dealt.mapInPandas(run, ", ".join([f"{k} {types[k]}" for k in key] + [schema]))
