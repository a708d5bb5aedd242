"""Data source "lamina": a framed container for rows in the wire format.

The wire has no framing, so a file is: magic, version, schema (JSON), then one frame per row (varint length, wire bytes of
the row as a struct), then a footer of row count and CRC-32.  Files are written one per task under a temporary name and
moved on commit.  Paths are mounted ones, or of a file system that pyarrow opens (file, s3, gs, abfs, hdfs); files are
streamed, a frame at a time.  read_container() reads through Spark's own file systems, whatever they are.

    spark.dataSource.register(ContainerSource)
    df.write.format("lamina").mode("append").save(path)
    spark.read.format("lamina").load(path)                      # schema comes from the files
    read_container(spark, path, ["id"])                         # only the named columns are built
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import wire as w

MAGIC, VERSION = b"LMNA", 1
SUFFIX = ".lmna"


#: Bytes of a file read at a time.
CHUNK = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """Containers of a folder, or the file itself, as paths within the store."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        return sorted(x.path for x in store.get_file_info(pafs.FileSelector(at)) if x.path.endswith(SUFFIX))
    return [at] if info.type == pafs.FileType.File else []


class _Stream(w.Reader):
    """A Reader over a file of which a chunk is held; keeps the checksum of what has been taken."""

    def __init__(self, file, size: int):
        super().__init__(b"")
        self.file, self.rest, self.checksum = file, size, 0

    def take(self, n: int) -> bytes:
        if self.position + n > len(self.data):
            held = bytes(self.data[self.position :])
            more = self.file.read(min(self.rest, max(CHUNK, n - len(held))))
            self.rest -= len(more)
            self.data, self.position = memoryview(held + more), 0
        out = super().take(n)
        self.checksum = zlib.crc32(out, self.checksum)
        return out

    def left(self) -> int:
        return len(self.data) - self.position + self.rest


def read_header(reader: w.Reader) -> T.StructType:
    if reader.take(4) != MAGIC:
        raise w.InvalidData("not a container")
    if (version := reader.take(1)[0]) != VERSION:
        raise w.InvalidData(f"version {version}")
    return T.StructType.fromJson(json.loads(reader.take(w.read_varint(reader))))


def header(schema: T.StructType) -> bytes:
    text = schema.json().encode()
    return MAGIC + bytes((VERSION,)) + w.varint(len(text)) + text


@dataclass
class _Part(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


def rows_of(reader: w.Reader, count: int, names: list[str]) -> Iterator[tuple]:
    """The named fields of the frames behind a header."""
    from ..operators.structural import codec_of

    stored = read_header(reader)
    codec = codec_of(stored)
    for _ in range(count):
        row = codec.loads(reader.take(w.read_varint(reader)))
        yield tuple(row[n] for n in names)
    if reader.left():
        raise w.InvalidData("bytes behind the last frame")


def _footer(data: bytes) -> tuple[int, int]:
    if len(data) < 12:
        raise w.ReaderOutOfData("a container without footer")
    return struct.unpack("<QI", data[-12:])


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_Part(p) for p in _files(self.path)]

    def read(self, partition):
        if partition is None or not getattr(partition, "path", None):
            return
        store = _store(self.path)[0]
        size = store.get_file_info(partition.path).size
        with store.open_input_file(partition.path) as f:
            f.seek(max(0, size - 12))
            count, checksum = _footer(f.read(12))
            f.seek(0)
            stream = _Stream(f, size - 12)
            yield from rows_of(stream, count, [x.name for x in self.schema.fields])
            if stream.checksum != checksum:
                raise w.InvalidData("a container with another checksum")


def read_container(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Containers through Spark's file systems (a file is held whole by a task), the named columns alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    head = files.selectExpr(f"substring(content, 1, {CHUNK}) as head").first()
    if head is None:
        raise w.InvalidData("no container there")
    stored = read_header(w.Reader(bytes(head["head"])))
    schema = T.StructType([stored[c] for c in columns or stored.names])
    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for item in batch.column(0):
                data = item.as_py()
                count, checksum = _footer(data)
                if zlib.crc32(data[:-12]) != checksum:
                    raise w.InvalidData("a container with another checksum")
                rows = list(rows_of(w.Reader(data[:-12]), count, schema.names))
                cells = list(zip(*rows, strict=True)) or [()] * len(schema.names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, arrow, strict=True)], schema=arrow)

    return files.select("content").mapInArrow(read, schema)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema = path, schema
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        self.before = _files(path) if overwrite else []

    def write(self, rows):
        from ..operators.structural import codec_of

        codec, name = codec_of(self.schema), uuid.uuid4().hex
        store, at = _store(self.path)
        temporary = f"{at.rstrip('/')}/.{name}.part"
        checksum = count = 0
        with store.open_output_stream(temporary) as f:

            def put(data: bytes) -> None:
                nonlocal checksum
                checksum = zlib.crc32(data, checksum)
                f.write(data)

            put(header(self.schema))
            for row in rows:
                body = codec.dumps(tuple(row))
                put(w.varint(len(body)) + body)
                count += 1
            f.write(struct.pack("<QI", count, checksum))
        return _Written(temporary, f"{at.rstrip('/')}/{name}{SUFFIX}")

    def commit(self, messages):
        store = _store(self.path)[0]
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)
        for old in self.before:
            store.delete_file(old)

    def abort(self, messages):
        store = _store(self.path)[0]
        for m in messages:
            if m is not None and store.get_file_info(m.temporary).type == pafs.FileType.File:
                store.delete_file(m.temporary)


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "lamina"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise w.InvalidData("no container there")
        with _store(self.options["path"])[0].open_input_stream(files[0]) as f:
            return read_header(w.Reader(f.read(CHUNK)))

    def reader(self, schema):
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite)
