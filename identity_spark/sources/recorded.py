"""Recordings as tables and streams: motion-JPEG files by frame, message logs by line, each record with its byte offset.

Files are cut into byte ranges that are read in parallel. A record belongs to the range that it begins in, wherever it
ends, so any size of ranges gives the same rows. A stream goes on where a file has grown, up to its last whole record.
Paths are whatever PyArrow's file systems take: local ones, hdfs://, s3:// and others."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Of records that are handed to Spark at once.
BATCH_BYTES = 8 << 20
#: A JPEG picture's first and last two bytes. Between two pictures up to 16 bytes of padding may stand.
FIRST, LAST = b"\xff\xd8", b"\xff\xd9"
BETWEEN = {"frames": re.compile(rb"\xff\xd9[\x00\r\n]{0,16}(?=\xff\xd8)"), "lines": re.compile(rb"\n")}
OVERLAP = 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder whose names don't begin with a dot or an underscore."""
    system, place = opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def whole_end(file: pa.NativeFile, size: int, kind: str, finished: bool) -> int:
    """Where the last whole record of the first ``size`` bytes ends; finished: a last line needs no line end."""
    if kind == "lines" and finished:
        return size
    mark, at = LAST if kind == "frames" else b"\n", size
    while at > 0:
        start = max(0, at - READ_BYTES)
        found = file.read_at(min(size, at + 1) - start, start).rfind(mark)
        if found >= 0:
            return start + found + len(mark)
        at = start
    return 0


def records(file: pa.NativeFile, start: int, stop: int, end: int, kind: str) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that begin in [start, stop) of a file whose whole records end at ``end``."""
    between = BETWEEN[kind]
    base = max(0, start - OVERLAP)  # of the buffer in the file
    data, read_to = b"", base

    def more() -> bool:
        nonlocal data, read_to
        got = file.read_at(min(READ_BYTES, end - read_to), read_to) if read_to < end else b""
        data, read_to = data + got, read_to + len(got)
        return bool(got)

    at = None  # where the current record begins in the buffer
    if base == 0:
        more()
        while kind == "frames" and len(data) < 2 and more():
            pass
        if start == 0 and end and (kind == "lines" or data.startswith(FIRST)):
            at = 0
    seek = 0
    while True:
        m = between.search(data, seek)
        # a mark at the buffer's end may go on in what isn't read yet
        if m is None or (kind == "frames" and m.end() + 2 > len(data) and read_to < end):
            seek = max(seek, len(data) - OVERLAP)
            if at is not None:
                seek = max(at, min(seek, len(data) - OVERLAP))
            if more():
                if at is None and seek > READ_BYTES:  # nothing of it is needed any more
                    data, base, seek = data[seek:], base + seek, 0
                    if base >= stop:
                        return
                continue
            if at is not None and base + at < stop and at < len(data):
                last = data[at:].rstrip(b"\n") if kind == "lines" else data[at:]
                if kind == "lines" or last.endswith(LAST):
                    yield base + at, last
            return
        if at is not None:
            yield base + at, data[at : m.start() + (2 if kind == "frames" else 0)]
        begins = m.end()
        if base + begins >= stop:
            return
        at = begins if base + begins >= start else None
        data, base, seek = data[begins:], base + begins, 0
        at = 0 if at is not None else None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    end: int


class _Source:
    def __init__(self, options: dict[str, str]):
        self.kind, self.path = options.get("kind", "frames"), options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if self.kind not in BETWEEN:
            raise ValueError(f"unknown kind {self.kind!r}; known ones are frames and lines")

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, a, min(a + self.split, end), end) for a in range(start, end, self.split)]

    def ends(self, finished: bool) -> dict[str, int]:
        system = opened(self.path)[0]
        out = {}
        for path, size in files_of(self.path):
            with system.open_input_file(path) as f:
                out[path] = whole_end(f, size, self.kind, finished)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        value = "frame" if self.kind == "frames" else "value"
        rows: list[tuple[int, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            content = pa.array([r[1] for r in rows], pa.binary())
            content = content if self.kind == "frames" else pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), content], ["path", "offset", value])

        with opened(self.path)[0].open_input_file(partition.path) as f:
            for offset, content in records(f, partition.start, partition.stop, partition.end, self.kind):
                rows.append((offset, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class _Reader(_Source, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, end in self.ends(True).items() for r in self.ranges(path, 0, end)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter([])


class _StreamReader(_Source, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.ends(False)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, stop in end.items() for r in self.ranges(path, start.get(path, 0), stop)]

    def commit(self, end: dict) -> None:
        pass


class Recorded(DataSource):
    """Format "recorded": options kind ("frames" or "lines") and splitBytes; path, offset, and frame (bytes) or value (text)."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "path string, offset long, " + ("frame binary" if self.options.get("kind", "frames") == "frames" else "value string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def read_recorded(spark: SparkSession, path: str, kind: str = "frames", stream: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of a file or folder. A stream of lines can go on to :mod:`identity_spark.sources.messages` as it is."""
    spark.dataSource.register(Recorded)
    source = spark.readStream if stream else spark.read
    return source.format("recorded").option("kind", kind).option("splitBytes", split_bytes).load(path)


def numbered_frames(frames: DataFrame) -> DataFrame:
    """Adds frame_idx: a frame's place in its file, from 0. Numbers are given to paths and offsets, so no picture is shuffled
    but in the join, where a broadcast of these serves small recordings."""
    places = frames.select("path", "offset")
    numbers = places.withColumn("frame_idx", F.row_number().over(Window.partitionBy("path").orderBy("offset")).cast("long") - 1)
    return frames.join(numbers, ["path", "offset"])


def write_recording(frames: DataFrame, path: str) -> DataFrame:
    """Frames (camera_id, frame_idx, frame) as a file ``camera=<id>.mjpeg`` for each camera, in order; gives camera_id, path
    and n_frames. A camera's frames stream through one task, and a try that is repeated writes its file anew."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(path)
        system.create_dir(place)
        file = camera = None
        n, done = 0, []
        for batch in batches:
            for c, frame in zip(batch.column("camera_id").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if file is None or c != camera:
                    if file is not None:
                        done.append((camera, n))
                        close(system, file, place, camera)
                    camera, n = c, 0
                    file = system.open_output_stream(f"{place}/.camera={c}.{TaskContext.get().taskAttemptId()}")
                file.write(frame)
                n += 1
        if file is not None:
            done.append((camera, n))
            close(system, file, place, camera)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([f"{place}/camera={d[0]}.mjpeg" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["camera_id", "path", "n_frames"])

    def close(system: fs.FileSystem, file: pa.NativeFile, place: str, camera: int) -> None:
        file.close()
        system.move(f"{place}/.camera={camera}.{TaskContext.get().taskAttemptId()}", f"{place}/camera={camera}.mjpeg")

    dealt = frames.filter("frame IS NOT NULL").select("camera_id", "frame_idx", "frame").repartition("camera_id").sortWithinPartitions("camera_id", "frame_idx")
    return dealt.mapInArrow(write, "camera_id long, path string, n_frames long")

