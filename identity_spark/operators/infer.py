"""Models that the caller brings, run over tables in batches; the model is built once for each task."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

Model = Callable[[list], list]
log = logging.getLogger(__name__)


def attempted(model: Model, given: list) -> list[tuple[object, str | None]]:
    """(output, None) of each input, or (None, error): where a batch fails its halves are tried, down to one input.

    So what one input costs is its own output, and some 2 * log2(n) calls of the model more."""
    if not given:
        return []
    try:
        return [(x, None) for _, x in zip(given, model(given), strict=True)]
    except Exception as e:  # noqa: BLE001  a model may raise anything
        if len(given) == 1:
            log.warning("a model failed on one input: %r", e)
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(given) // 2
    return attempted(model, given[:half]) + attempted(model, given[half:])


def _size(x: object) -> int:
    """Bytes of an input, about."""
    return len(x) * (1 if isinstance(x, (bytes, bytearray, str)) else 8) if hasattr(x, "__len__") else 8


def run_model(
    rows: DataFrame, factories: dict[str, Callable[[], Model]], strategy: str, column: str, out: str, kind: str, *,
    unit_length: bool = False, batch: int = 64, batch_bytes: int = 64 << 20, errors: str | None = None, took: str | None = None, profile: ResourceProfile | None = None,
) -> DataFrame:
    """Adds ``out`` (of the type ``kind``): what the named strategy's model makes of ``column``.

    factories: strategy -> function that builds the model; an unknown strategy is an error at once. The model takes a
    list of inputs that aren't null, up to ``batch`` of them and (but for a single one) ``batch_bytes``, and gives a list
    of as many outputs. An input on which it fails by itself has a null output and is logged; errors: a column for what it
    said. unit_length: outputs are vectors, to be brought to length 1. profile: resources of the model's stage, such as
    a GPU a task, where the cluster deals them out by stage. took: a column for the milliseconds that the model took, each
    row's share of its batch; they are those of the run that made the row."""
    if strategy not in factories:
        raise ValueError(f"unknown strategy {strategy!r}; known ones are {', '.join(sorted(factories))}")
    make = factories[strategy]
    arrow = to_arrow_type(DataType.fromDDL(kind))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{out}` {kind}"] + ([f"`{errors}` string"] if errors else []) + ([f"`{took}` double"] if took else []))

    def unit(v: list | None) -> list | None:
        if v is None:
            return None
        x = np.asarray(v, float)
        return (x / max(float(np.sqrt(x @ x)), 1e-12)).tolist()

    def portions(given: list) -> Iterator[tuple[int, int]]:
        start = size = 0
        for i, x in enumerate(given):
            own = 0 if x is None else _size(x)
            if i > start and (i - start >= batch or size + own > batch_bytes):
                yield start, i
                start, size = i, 0
            size += own
        if len(given) > start:
            yield start, len(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            values = whole.column(column).to_pylist()
            for start, end in portions(values):
                some, given = whole.slice(start, end - start), values[start:end]
                at = [i for i, x in enumerate(given) if x is not None]
                made: list = [None] * len(given)
                said: list = [None] * len(given)
                began = time.perf_counter()
                results = attempted(model, [given[i] for i in at])
                share = 1000 * (time.perf_counter() - began) / max(1, len(given))
                for i, (x, error) in zip(at, results, strict=True):
                    made[i], said[i] = unit(x) if unit_length else x, error
                more = ([pa.array(said, pa.string())] if errors else []) + ([pa.array(np.full(len(given), share))] if took else [])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, arrow), *more], [*some.schema.names, out, *[c for c in (errors, took) if c]])

    return rows.mapInArrow(run, fields, profile=profile)


def embed_table(rows: DataFrame, factories: dict[str, Callable[[], Model]], strategy: str, column: str = "crop", out: str = "embedding", **how) -> DataFrame:
    """Adds unit embeddings of crops; null for a null crop or one that the model fails on. how: as :func:`run_model` takes it."""
    return run_model(rows, factories, strategy, column, out, "array<double>", unit_length=True, **how)


def pose_table(frames: DataFrame, factories: dict[str, Callable[[], Model]], strategy: str, column: str = "frame", **how) -> DataFrame:
    """Poses of each frame, a row each: pose_seq, x1..y2, score, kps."""
    pose = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,kps:array<struct<x:double,y:double,c:double>>>>"
    return _exploded(run_model(frames, factories, strategy, column, "_found", pose, **how), column, "pose_seq")


def face_table(frames: DataFrame, factories: dict[str, Callable[[], Model]], strategy: str, column: str = "frame", **how) -> DataFrame:
    """Faces of each frame, a row each: face_seq, x1..y2, score, embedding (unit length is the model's part)."""
    face = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double,embedding:array<double>>>"
    return _exploded(run_model(frames, factories, strategy, column, "_found", face, **how), column, "face_seq")


def _exploded(rows: DataFrame, column: str, seq: str) -> DataFrame:
    from pyspark.sql import functions as F

    kept = [c for c in rows.columns if c not in (column, "_found")]
    return rows.select(*kept, F.posexplode("_found").alias(seq, "_f")).select(*kept, seq, "_f.*")
