"""A data source and sink of rows with a whole-number key, in files of Arrow record batches.

``df.write.format("heddle_frames").option("key", "doc_id").mode("append").save(uri)`` and ``spark.read.format("heddle_frames").load(uri)``,
after ``register(spark)``. ``uri`` is a path or URI that ``pyarrow.fs`` opens, on storage that the driver and all executors share.

A folder holds ``data/<job>/``, the files that a job's tasks have written, and ``versions/``, one small JSON file for each committed job, which
names its files with their rows and least and greatest key. Readers see only what versions name:

- A task writes to files of its own attempt. When all tasks have ended, the driver deletes files of attempts that lost, then puts the
  version in place by one rename. If the job fails its folder goes, and no version ever names it.
- An overwriting job's version says that it replaces those before it; their files stay for readers that have begun, until ``vacuum``.
- A micro-batch of a stream is committed once: its version carries the batch's number, and a batch that is run again after a restart
  is dropped.

Files are read one per task. Those whose keys lie outside the range asked for (options ``least`` and ``most``, both included, or filters
on the key where ``pushdown`` is set) are not opened; within a file, record batches outside of it are not read. Option ``columns`` reads some columns only.

Defined results: rows with a null key are kept, and a range leaves them out; an empty table has a version without files, and reads as an empty
table of its schema; a folder without versions is an error; an appending job must have the schema of the folder. One job at a time writes to a folder.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

NAME = "heddle_frames"
#: A file is closed when its batches hold so many bytes (before compression).
FILE_BYTES = 128 << 20


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return found, path.rstrip("/")


def _versions(uri: str) -> list[dict]:
    """The versions that count, oldest first: the last one that replaces, and those after it."""
    store, path = _place(uri)
    infos = store.get_file_info(fs.FileSelector(f"{path}/versions", allow_not_found=True))
    names = sorted(i.path for i in infos if i.base_name.endswith(".json"))
    found: list[dict] = []
    for name in reversed(names):
        with store.open_input_stream(name) as f:
            found.append(json.loads(f.read()) | {"number": int(name.rsplit("/", 1)[1][:-5])})
        if found[-1]["replaces"]:
            break
    return found[::-1]


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: name, rows, least and greatest key."""

    files: list[tuple[str, int, int | None, int | None]]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, key: str, schema: StructType, overwrite: bool, file_bytes: int):
        self.uri, self.key, self.schema, self.overwrite, self.file_bytes = uri, key, schema.json(), overwrite, file_bytes
        self.job = uuid.uuid4().hex
        if key not in schema.names or schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"the key {key} must be a column of whole numbers")
        held = [] if overwrite else _versions(uri)
        if held and (held[-1]["schema"], held[-1]["key"]) != (self.schema, key):
            raise ValueError("the folder holds rows of another schema or key")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _place(self.uri)
        folder = f"{path}/data/{self.job}"
        files, sink, writer = [], None, None

        def close() -> None:
            writer.close()
            sink.close()
            with store.open_output_stream(f"{folder}/{name}.ranges") as f:
                f.write(json.dumps(ranges).encode())
            known = [r for r in ranges if r[1] is not None]
            least, most = (min(r[1] for r in known), max(r[2] for r in known)) if known else (None, None)
            files.append((f"{self.job}/{name}", sum(r[0] for r in ranges), least, most))

        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(folder, recursive=True)
                name, ranges, held = f"{uuid.uuid4().hex}.arrow", [], 0
                sink = store.open_output_stream(f"{folder}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            ends = pc.min_max(batch.column(self.key))
            ranges.append((batch.num_rows, ends["min"].as_py(), ends["max"].as_py()))
            held += batch.nbytes
            if held >= self.file_bytes:
                close()
                writer = None
        if writer is not None:
            close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _place(self.uri)
        if store.get_file_info(f"{path}/data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/data/{self.job}")

    def _commit(self, messages: list[WriterCommitMessage | None], batch: str | None) -> None:
        store, path = _place(self.uri)
        files = [f for m in messages if m is not None for f in m.files]
        kept = {f"{path}/data/{f[0]}{end}" for f in files for end in ("", ".ranges")}
        for info in store.get_file_info(fs.FileSelector(f"{path}/data/{self.job}", allow_not_found=True)):
            if info.path not in kept:  # of an attempt that lost
                store.delete_file(info.path)
        last = _versions(self.uri)
        number = last[-1]["number"] + 1 if last else 1
        body = {"schema": self.schema, "key": self.key, "replaces": self.overwrite or not last, "batch": batch, "files": files}
        store.create_dir(f"{path}/versions", recursive=True)
        with store.open_output_stream(f"{path}/versions/{self.job}.new") as f:
            f.write(json.dumps(body).encode())
        store.move(f"{path}/versions/{self.job}.new", f"{path}/versions/{number:010d}.json")


class StreamFrameWriter(DataSourceStreamArrowWriter):
    """The same for the micro-batches of a query; ``query`` names it in the versions."""

    def __init__(self, uri: str, key: str, schema: StructType, file_bytes: int, query: str):
        self.inner, self.query = FrameWriter(uri, key, schema, False, file_bytes), query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.inner.write(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        name = f"{self.query}:{batchId}"
        if any(v["batch"] == name for v in _versions(self.inner.uri)):
            self._drop(messages)
        else:
            self.inner._commit(messages, name)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)

    def _drop(self, messages: list[WriterCommitMessage | None]) -> None:
        """One writer serves all batches of a query, so only this batch's files go."""
        store, path = _place(self.inner.uri)
        for f in [f for m in messages if m is not None for f in m.files]:
            for end in ("", ".ranges"):
                store.delete_file(f"{path}/data/{f[0]}{end}")


@dataclass
class File(InputPartition):
    name: str


class FrameReader(DataSourceReader):
    def __init__(self, uri: str, least: int | None, most: int | None, names: list[str]):
        self.uri, self.least, self.most, self.names = uri, least, most, names
        self.key = _versions(uri)[-1]["key"]

    def _meets(self, least: int | None, most: int | None) -> bool:
        if self.least is None and self.most is None:
            return True
        if least is None:
            return False
        return (self.most is None or least <= self.most) and (self.least is None or most >= self.least)

    def partitions(self) -> list[InputPartition]:
        return [File(name) for v in _versions(self.uri) for name, _, least, most in v["files"] if self._meets(least, most)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, File):  # there are no files: Spark asks for one partition
            return
        store, path = _place(self.uri)
        with store.open_input_stream(f"{path}/data/{partition.name}.ranges") as f:
            ranges = json.loads(f.read())
        with store.open_input_file(f"{path}/data/{partition.name}") as f:
            with pa.ipc.open_file(f) as whole:
                fields = sorted({whole.schema.get_field_index(c) for c in [self.key, *self.names]})
            f.seek(0)
            with pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=fields)) as opened:
                for i, (_, least, most) in enumerate(ranges):
                    if self._meets(least, most):
                        yield self._cut(opened.get_batch(i)).select(self.names)

    def _cut(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        key = batch.column(self.key)
        for end, keep in ((self.least, pc.greater_equal), (self.most, pc.less_equal)):
            if end is not None:
                batch = batch.filter(keep(key, end))
                key = batch.column(self.key)
        return batch


class PushingReader(FrameReader):
    """Takes its range from filters on the key as well. Spark applies all filters again."""

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                low = high = None
                if isinstance(f, EqualTo):
                    low = high = f.value
                elif isinstance(f, In) and f.value:
                    low, high = min(f.value), max(f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = f.value
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = f.value
                if low is not None:
                    self.least = low if self.least is None else max(self.least, low)
                if high is not None:
                    self.most = high if self.most is None else min(self.most, high)
            yield f


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _option(self, name: str, default: str | None = None) -> str | None:
        found = self.options.get(name, default)
        if found is None and name in ("path", "key"):
            raise ValueError(f"{NAME} needs the option {name}")
        return found

    def schema(self) -> StructType:
        held = _versions(self._option("path"))
        if not held:
            raise ValueError(f"{self._option('path')} holds no version")
        whole = StructType.fromJson(json.loads(held[-1]["schema"]))
        if (some := self._option("columns")) is None:
            return whole
        return StructType([whole[c.strip()] for c in some.split(",")])

    def reader(self, schema: StructType) -> DataSourceReader:
        ends = [None if (x := self._option(n)) is None else int(x) for n in ("least", "most")]
        kind = PushingReader if self._option("pushdown", "false").lower() == "true" else FrameReader
        return kind(self._option("path"), *ends, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self._option("path"), self._option("key"), schema, overwrite, int(self._option("fileBytes", str(FILE_BYTES))))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamFrameWriter:  # noqa: N802
        size = int(self._option("fileBytes", str(FILE_BYTES)))
        return StreamFrameWriter(self._option("path"), self._option("key"), schema, size, self._option("query", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)


def write_frames(df: DataFrame, uri: str, key: str, mode: str = "append", files: int | None = None) -> None:
    """Write ``df`` in ranges of the key, so that readers open few files for a range of keys."""
    register(df.sparkSession)
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.format(NAME).option("key", key).mode(mode).save(uri)


def read_frames(spark: SparkSession, uri: str, least: int | None = None, most: int | None = None, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    options = {"least": least, "most": most, "columns": ",".join(columns) if columns else None}
    return spark.read.format(NAME).options(**{k: v for k, v in options.items() if v is not None}).load(uri)


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that the cluster names in ``spark.checkpoint.dir``, deleted when the driver's Python ends.

    Where that is unset, a temporary folder stands in for it if driver and executors are one process; else it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="heddle-")
    uri = f"{re.sub('^file:/+', '/', shared).rstrip('/')}/heddle-frames-{uuid.uuid4().hex}"

    def remove() -> None:
        store, path = _place(uri)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)

    atexit.register(remove)
    return uri


def vacuum(uri: str) -> int:
    """Delete files that no version which counts names, when no job writes or reads; returns how many."""
    store, path = _place(uri)
    held = _versions(uri)
    named = {f"{path}/data/{f[0]}{end}" for v in held for f in v["files"] for end in ("", ".ranges")}
    gone = 0
    for info in store.get_file_info(fs.FileSelector(f"{path}/data", recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and info.path not in named:
            store.delete_file(info.path)
            gone += 1
    first = held[0]["number"] if held else 0
    for info in store.get_file_info(fs.FileSelector(f"{path}/versions", allow_not_found=True)):
        if info.base_name.endswith(".json") and int(info.base_name[:-5]) < first:
            store.delete_file(info.path)
    return gone
