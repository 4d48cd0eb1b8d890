"""``format("tcptrace")``: fixed-length binary trace files as a batch source, a stream source and a sink.

Files are cut at multiples of the record length; a last partial record belongs to no part. Paths may be any that
pyarrow's file systems open. Options: ``kind``; ``mode`` (FAILFAST, PERMISSIVE with ``_corrupt``, DROPMALFORMED) for
records without the marker; ``partitionBytes``; ``columns``, a list of fields to decode.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from flowseries.schema import FILES, KINDS, MARKER, Kind

_BATCH = 1 << 16
_INFO = (("_file", T.StringType()), ("_offset", T.LongType()), ("_corrupt", T.BooleanType()))


def open_filesystem(path: str):
    """pyarrow's file system for a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path) else f"file://{path}")


#: The folder of appends: each is a folder of its own, named by its number.
APPENDS = "appends"


def append_folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{APPENDS}/{number:012d}"


def _numbers(system, folder: str) -> list[int]:
    from pyarrow import fs

    return sorted(int(f.base_name) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.isdigit())


def last_append(path: str, known: int | None = None) -> int:
    """The highest number of an append, 0 without; from a ``known`` one on only the next ones are looked for."""
    from pyarrow import fs

    system, inner = open_filesystem(path)
    if known is None:
        return max(_numbers(system, f"{inner}/{APPENDS}"), default=0)
    while system.get_file_info(append_folder(inner, known + 1)).type == fs.FileType.Directory:
        known += 1
    return known


def list_files(path: str, appends: bool = True) -> list[tuple[str, int]]:
    """Names and lengths of a file, or of the ``.tcp`` files under a folder; nothing where there is none. Without
    ``appends`` those of the folder's own appends are neither listed nor looked at."""
    from pyarrow import fs

    system, inner = open_filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    for folder in [f for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(".") and (appends or f.base_name != APPENDS)]:
        found += system.get_file_info(fs.FileSelector(folder.path, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else re.match(r"^([A-Za-z0-9+.-]+:(?://)?)?", path)[0]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".tcp"))


def publish_append(system, inner: str, written: str) -> None:
    """The folder ``written`` as the next append of the trace ``inner``: there at once and whole, or not at all."""
    folder = f"{inner}/{APPENDS}"
    system.create_dir(folder, recursive=True)
    number = max(_numbers(system, folder), default=0)
    for tried in range(1, 101):
        try:
            return system.move(written, append_folder(inner, number + tried))
        except OSError:
            # Another append took the number.
            if tried == 100:
                raise


@dataclass
class TracePart(InputPartition):
    path: str
    start: int
    end: int


def parts_of(path: str, size: int, start: int, end: int, part_bytes: int) -> list[TracePart]:
    step = max(size, part_bytes // size * size)
    return [TracePart(path, a, min(end, a + step)) for a in range(start, end, step)]


def decode(kind: Kind, raw: bytes, path: str, offset: int, mode: str, fields: list[str]) -> pa.RecordBatch:
    """Whole records of ``raw`` as columns."""
    rows = np.frombuffer(raw, dtype=kind.dtype)
    good = np.frombuffer(rows["marker"].tobytes(), dtype="<u4") == 0xFFFFFFFF
    offsets = offset + np.arange(len(rows), dtype=np.int64) * kind.size
    if mode == "FAILFAST" and not good.all():
        raise ValueError(f"record without marker in {path} at byte {offsets[~good][0]}")
    if mode == "DROPMALFORMED":
        rows, offsets, good = rows[good], offsets[good], good[good]
    columns: dict[str, pa.Array] = {}
    bad = pa.array(~good)
    for name, code in kind.fields:
        if name not in fields:
            continue
        if code[0] == "V":
            width = int(code[1:])
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows[name]).tobytes())]).cast(pa.binary())
        elif code == "?":
            values = pa.array(rows[name].view(np.uint8) != 0)
        else:
            values = pa.array(rows[name].astype(np.int64))  # 64-bit unsigned numbers wrap
        columns[name] = pa.compute.if_else(bad, pa.scalar(None, values.type), values) if not good.all() else values
    info = {"_file": pa.array([path] * len(rows), pa.string()), "_offset": pa.array(offsets), "_corrupt": bad}
    columns |= {n: info[n] for n, _ in _INFO if n in fields}
    return pa.RecordBatch.from_arrays([columns[f] for f in fields], names=fields)


def read_part(kind: Kind, part: TracePart, mode: str, fields: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    system, inner = open_filesystem(part.path)
    with system.open_input_file(inner) as f:
        for at in range(part.start, part.end, _BATCH * kind.size):
            f.seek(at)
            want = min(part.end - at, _BATCH * kind.size)
            raw = f.read(want)
            yield decode(kind, raw[: len(raw) // kind.size * kind.size], part.path, at, mode, fields)


class _Options:
    def __init__(self, options, schema: T.StructType):
        self.kind, self.path = KINDS[options["kind"]], options.get("path", "")
        self.mode = options.get("mode", "FAILFAST").upper()
        self.part_bytes = int(options.get("partitionBytes", 64 << 20))
        self.fields = [f.name for f in schema]

    def whole(self, length: int) -> int:
        return length // self.kind.size * self.kind.size


class TraceReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.o = _Options(options, schema)

    def partitions(self) -> list[TracePart]:
        o = self.o
        found = [p for path, n in list_files(o.path) for p in parts_of(path, o.kind.size, 0, o.whole(n), o.part_bytes)]
        return found or [TracePart("", 0, 0)]

    def read(self, partition: TracePart) -> Iterator[pa.RecordBatch]:
        return read_part(self.o.kind, partition, self.o.mode, self.o.fields) if partition.path else iter(())


class TraceStreamReader(DataSourceStreamReader):
    """Offsets are the number of the last append, under an empty name, and the bytes, whole records only, of each file
    that lies elsewhere and so may grow. Appends never change and become visible in the order of their numbers, so what
    an offset says, and what a trigger looks for, doesn't grow with them. A trigger takes all that is there, in parts as
    a batch does: Spark doesn't tell a Python source where it stands, so a limit for each trigger couldn't survive a
    restart."""

    def __init__(self, options, schema: T.StructType):
        self.o = _Options(options, schema)
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"": 0}

    def latestOffset(self) -> dict:
        self.last = last_append(self.o.path, self.last)
        return {"": self.last, **{path: self.o.whole(length) for path, length in list_files(self.o.path, appends=False)}}

    def partitions(self, start: dict, end: dict) -> list[TracePart]:
        size = self.o.kind.size
        grown = [p for path, n in sorted(end.items()) if path for p in parts_of(path, size, int(start.get(path, 0)), int(n), self.o.part_bytes)]
        new = [f for i in range(int(start.get("", 0)) + 1, int(end.get("", 0)) + 1) for f in list_files(append_folder(self.o.path, i))]
        return grown + [p for path, n in new for p in parts_of(path, size, 0, self.o.whole(n), self.o.part_bytes)]

    def read(self, partition: TracePart) -> Iterator[pa.RecordBatch]:
        return read_part(self.o.kind, partition, self.o.mode, self.o.fields)

    def commit(self, end: dict) -> None:
        pass


def encode(kind: Kind, batch: pa.RecordBatch) -> bytes:
    """Records with markers; null and absent fields are zero."""
    out = np.zeros(batch.num_rows, dtype=kind.dtype)
    out["marker"] = np.void(MARKER)
    for name, code in kind.fields:
        at = batch.schema.get_field_index(name)
        if at < 0:
            continue
        if code[0] == "V":
            width = int(code[1:])
            joined = b"".join((v or b"")[:width].ljust(width, b"\0") for v in batch.column(at).to_pylist())
            out[name] = np.frombuffer(joined, dtype=f"V{width}")
        else:
            values = batch.column(at).fill_null(False if code == "?" else 0).to_numpy(zero_copy_only=False)
            out[name] = values if code == "?" else values.astype(np.int64).astype(code)
    return out.tobytes()


@dataclass
class Written(WriterCommitMessage):
    own: str
    name: str


class TraceWriter(DataSourceArrowWriter):
    """One file for each task, in a folder that becomes the trace's next append when the job commits. An append never
    replaces records that are there, and a task that runs again leaves one file."""

    def __init__(self, options, overwrite: bool):
        self.kind, self.path = KINDS[options["kind"]], options["path"]
        self.name, self.overwrite, self.job = options.get("name", "part"), overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple:
        system, inner = open_filesystem(self.path)
        return system, inner, f"{inner}/.writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        own, name = f"{folder}/.attempt-{context.taskAttemptId()}", f"{folder}/{self.name}-{self.job}-{context.partitionId():05d}.tcp"
        with system.open_output_stream(own, compression=None) as f:
            for batch in iterator:
                f.write(encode(self.kind, batch))
        return Written(own, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner, folder = self._folder()
        old = [open_filesystem(path)[1] for path, _ in list_files(self.path)] if self.overwrite else []
        for m in messages:
            if m:
                system.move(m.own, m.name)
        if any(messages):
            clear_attempts(system, folder)
            publish_append(system, inner, folder)
        for name in old:
            system.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def clear_attempts(system, folder: str) -> None:
    """Remove what tasks that ran in vain left."""
    from pyarrow import fs

    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.base_name.startswith("."):
            system.delete_file(f.path)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tcptrace"

    def schema(self) -> T.StructType:
        kind = KINDS[self.options["kind"]]
        whole = T.StructType([*kind.struct, *[T.StructField(n, t) for n, t in _INFO]])
        wanted = self.options.get("columns")
        return T.StructType([whole[c.strip()] for c in wanted.split(",")]) if wanted else whole

    def reader(self, schema: T.StructType) -> TraceReader:
        return TraceReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> TraceStreamReader:
        return TraceStreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def read_trace(spark: SparkSession, path: str, kind: str, direction: str | None = None, **options) -> DataFrame:
    """Records of the trace file, or of all trace files under the folder, ``path``."""
    register(spark)
    df = spark.read.format("tcptrace").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)
    return df.withColumn("direction", F.lit(direction).cast("string"))


def stream_trace(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("tcptrace").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)


def write_trace(df: DataFrame, path: str, kind: str, name: str = "part", mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("tcptrace").options(kind=kind, name=name).mode(mode).save(path)


def read_trace_dir(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """The known files (or folders) under ``path`` by kind, both directions together; absent ones are skipped."""
    from pyarrow import fs

    system, inner = open_filesystem(path)
    out: dict[str, DataFrame] = {}
    for stem, (kind, direction) in FILES.items():
        if system.get_file_info(f"{inner}/{stem}.tcp").type != fs.FileType.NotFound:
            df = read_trace(spark, f"{path.rstrip('/')}/{stem}.tcp", kind, direction, **options)
            out[kind] = out[kind].unionByName(df) if kind in out else df
    return out


def trace_files(spark: SparkSession, glob: str) -> DataFrame:
    """Path, length and time of trace files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tcp").option("recursiveFileLookup", "true").load(glob).select("path", "length", "modificationTime")


def write_raw(records: DataFrame, path: str, name: str = "part") -> None:
    """Whole records as bytes (column ``record``), as they are, as the trace's next append."""
    system, inner = open_filesystem(path)
    job = uuid.uuid4().hex
    folder = f"{inner}/.writing-{job}"
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = open_filesystem(path)
        there.create_dir(folder, recursive=True)
        context = TaskContext.get()
        own, n = f"{folder}/.attempt-{context.taskAttemptId()}", 0
        with there.open_output_stream(own, compression=None) as f:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    f.write(record)
                    n += 1
        there.move(own, f"{folder}/{name}-{job}-{context.partitionId():05d}.tcp")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    records.select("record").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    clear_attempts(system, folder)
    publish_append(system, inner, folder)
