"""A data source of Arrow files, file or stream format: spark.read.format("arrow_files").schema(...).load(path).

A file is read by as many tasks as its size asks for, a batch at a time, and only the columns that the schema names. In the file format
the footer tells where batches lie. A stream has no footer: a task reads the headers of its messages, passes over the bodies of batches
that aren't its own, and takes those that start in its range of bytes, with all dictionaries that stand before them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftwell.sources.storage import by_ranges, file_sizes, list_files, open_file

#: Bytes that a task reads.
RANGE = 64 << 20
#: Rows that are handed on at a time.
ROWS = 10_000

# Fixed values of the format: a message's marker and the kinds of messages.
_MARK = b"\xff\xff\xff\xff"
_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3


def _message(meta: bytes) -> tuple[int, int]:
    """A message's kind and the length of its body: fields 1 and 3 of the table that its metadata is."""
    table = struct.unpack_from("<I", meta)[0]
    fields = table - struct.unpack_from("<i", meta, table)[0]
    size = struct.unpack_from("<H", meta, fields)[0]

    def field(i: int, kind: str) -> int:
        at = struct.unpack_from("<H", meta, fields + 4 + 2 * i)[0] if 4 + 2 * i < size else 0
        return struct.unpack_from(kind, meta, table + at)[0] if at else 0

    return field(1, "<B"), field(3, "<q")


def messages(file, end: int) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of a stream's messages that start before a place; bodies aren't read."""
    at, size = 0, file.size()
    while at < min(end, size):
        file.seek(at)
        head = file.read(8)
        if len(head) < 8 or head[4:] == b"\0\0\0\0":
            return  # the stream's end
        if head[:4] != _MARK:
            raise ValueError("no Arrow stream, or one older than format version 0.15")
        length = struct.unpack("<i", head[4:])[0]
        kind, body = _message(file.read(length))
        if at + 8 + length + body > size:
            raise ValueError("an Arrow stream that ends within a message")
        yield kind, at, at + 8 + length + body
        at += 8 + length + body


class _Parts:
    """Some ranges of a file, read as if they were all of it."""

    closed = False

    def __init__(self, file, parts: list[tuple[int, int]]):
        self.file, self.parts, self.at = file, parts, 0

    def read(self, n: int = -1) -> bytes:
        out = []
        while self.parts and n != 0:
            start, end = self.parts[0]
            self.file.seek(start + self.at)
            got = self.file.read(end - start - self.at if n < 0 else min(n, end - start - self.at))
            self.at += len(got)
            n -= len(got) if n > 0 else 0
            out.append(got)
            if start + self.at == end:
                self.parts, self.at = self.parts[1:], 0
        return b"".join(out)

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        pass


def _options(names: list[str], schema: pa.Schema) -> pa.ipc.IpcReadOptions:
    missing = [n for n in names if n not in schema.names]
    if missing:
        raise KeyError(f"{missing} is none of {schema.names}")
    return pa.ipc.IpcReadOptions(included_fields=[schema.names.index(n) for n in names])


def read_range(uri: str, part: int, parts: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of one of so many parts of a file, each batch in exactly one of them."""
    with open_file(uri) as file:
        if file.read(6) == b"ARROW1":
            file.seek(0)
            with pa.ipc.open_file(file) as opened:
                options = _options(names, opened.schema)
            file.seek(0)
            with pa.ipc.open_file(file, options=options) as opened:
                n = opened.num_record_batches
                for i in range(n * part // parts, n * (part + 1) // parts):
                    yield opened.get_batch(i)
            return
        size = file.size()
        low, high = size * part // parts, size * (part + 1) // parts
        found = list(messages(file, high))
        if not found:
            return
        schema = pa.ipc.read_schema(pa.BufferReader(_Parts(file, [found[0][1:]]).read()))
        own = [(s, e) for kind, s, e in found if kind == _BATCH and s >= low]
        if own:
            before = [(s, e) for kind, s, e in found if kind in (_SCHEMA, _DICTIONARY)]
            source = pa.PythonFile(_Parts(file, sorted(before + own)), mode="r")
            yield from pa.ipc.open_stream(source, options=_options(names, schema))


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    return (column.dictionary_decode() if pa.types.is_dictionary(column.type) else column).cast(kind)


def to_schema(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A batch's columns as the schema has them, some rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield pa.RecordBatch.from_arrays([_as(part.column(f.name), f.type) for f in schema], schema=schema)


class _Range(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, files: list[tuple[str, int]], size: int):
        self.schema, self.files, self.size = schema, files, size

    def partitions(self) -> list[_Range]:
        return [_Range(path, i, n) for path, length in self.files for n in [max(1, -(-length // self.size))] for i in range(n)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for b in read_range(partition.path, partition.part, partition.parts, schema.names):
            yield from to_schema(b, schema)


class ArrowFiles(DataSource):
    """Options: path (a file, or a folder of them) or files (JSON of [path, bytes] pairs), rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        raise ValueError("arrow_files needs a schema: the columns to be read")

    def reader(self, schema: StructType) -> _Reader:
        files = json.loads(self.options["files"]) if "files" in self.options else list_files(self.options["path"])
        return _Reader(schema, sorted(tuple(f) for f in files), int(self.options.get("rangebytes", RANGE)))


def _whole_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files in a store that only Spark reads: a file a task, and in memory."""
    target = spark.createDataFrame([], schema).schema

    def run(batches):
        arrow = to_arrow_schema(target)
        for b in batches:
            for data in b.column(0).to_pylist():
                opened = pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)
                for x in opened if hasattr(opened, "read_next_batch") else (opened.get_batch(i) for i in range(opened.num_record_batches)):
                    yield from to_schema(x.select(arrow.names), arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_arrow(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE) -> DataFrame:
    """The schema's columns of Arrow files (file or stream format) that a path, folder or pattern names.

    Large files are read by many tasks, each holding one batch. Dictionary columns become their values, others are cast. A column that a
    file doesn't have raises, as does a file that is cut off; empty files and files without batches give no rows. Files in a store that
    only Spark can read are read whole, one a task.
    """
    files = [tuple(r) for r in file_sizes(spark, path).where("length > 0").collect()]  # names and sizes, as any reader lists them
    if not files:
        return spark.createDataFrame([], schema)
    if not by_ranges(files[0][0]):
        return _whole_files(spark, path, schema)
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_files").schema(schema).option("files", json.dumps(files)).option("rangebytes", range_bytes).load()
