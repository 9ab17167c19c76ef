"""Files of length-prefixed key/value records, as a Spark data source and sink.

A record is a little-endian 32-bit length and so many bytes of a two-field message: field 1 is the key, field
2 the value, both length-delimited. Missing fields are empty, unknown ones are skipped, of repeated ones the
last counts. Files have no marks to split at, so each is one partition. A file that ends within a record,
or a length over ``LARGEST``, is an error; a file that ends after one is simply over.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .paths import matching, opened, plain
from .text import ROW_BYTES, ROWS, packed, task_count

SCHEMA = "key binary, value binary, file string"
LARGEST = 64 << 20
_ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("file", pa.string())])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("damaged record: a number runs past its end")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def pack(key: bytes, value: bytes) -> bytes:
    """A record with its length."""
    message = b"\x0a" + _varint(len(key)) + key + b"\x12" + _varint(len(value)) + value
    if len(message) > LARGEST:
        raise ValueError(f"a record of {len(message)} bytes; the most is {LARGEST}")
    return struct.pack("<I", len(message)) + message


def unpack(message: bytes) -> tuple[bytes, bytes]:
    """Key and value of a message."""
    fields = {1: b"", 2: b""}
    at = 0
    while at < len(message):
        tag, at = _read_varint(message, at)
        wire = tag & 7
        if wire == 2:
            size, at = _read_varint(message, at)
            if at + size > len(message):
                raise ValueError("damaged record: a field runs past its end")
            fields[tag >> 3] = message[at : at + size]
            at += size
        elif wire == 0:
            _, at = _read_varint(message, at)
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        else:
            raise ValueError(f"damaged record: wire type {wire}")
    return fields[1], fields[2]


def read_records(stream) -> Iterator[tuple[bytes, bytes]]:
    """Keys and values of all records of a binary stream."""
    while head := stream.read(4):
        if len(head) < 4:
            raise EOFError("the file ends within a record's length")
        (size,) = struct.unpack("<I", head)
        if size > LARGEST:
            raise ValueError(f"damaged file: a record of {size} bytes")
        message = stream.read(size)
        if len(message) < size:
            raise EOFError("the file ends within a record")
        yield unpack(message)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RecordReader(DataSourceReader):
    """A file is a task; by file, tasks may have several, and each begins with a row of nulls."""

    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.tasks = int(options.get("tasks", 0))

    def partitions(self) -> list[Files]:
        if self.tasks:
            return [Files([path for path, _ in some]) for some in packed(self.files, self.tasks)]
        return [Files([path]) for path, _ in self.files]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for where in partition.paths:
            files, path = opened(where)
            name = plain(where)
            if self.tasks:
                rows.append((None, None, name))
            with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                for key, value in read_records(stream):
                    rows.append((key, value, name))
                    size += len(key) + len(value)
                    if len(rows) >= ROWS or size >= ROW_BYTES:
                        yield batch()
                        size = 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    """The temporary file of each path that a task wrote to, by the path's number."""

    temporary: dict[int, str]
    part: int


class RecordWriter(DataSourceWriter):
    """Tasks write files under names of their own; the driver gives those that count their final names.

    Rows say by number which of several paths they go to.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.paths, self.overwrite = json.loads(options["paths"]), overwrite

    def write(self, rows: Iterator) -> Written:
        part = TaskContext.get().partitionId()
        names: dict[int, str] = {}
        streams: dict[int, Any] = {}
        with ExitStack() as stack:
            for at, *pair in rows:
                if at not in streams:
                    files, folder = opened(self.paths[at])
                    names[at] = f"{folder}/.part-{part:05d}-{uuid.uuid4().hex}"
                    files.create_dir(folder, recursive=True)
                    streams[at] = stack.enter_context(files.open_output_stream(names[at], buffer_size=1 << 20))
                streams[at].write(pack(*(x.encode() if isinstance(x, str) else bytes(x or b"") for x in pair)))
        return Written(names, part)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        for at, path in enumerate(self.paths):
            files, folder = opened(path)
            files.create_dir(folder, recursive=True)
            written = {m.temporary[at]: m.part for m in messages if m and at in m.temporary}
            if self.overwrite:
                for info in files.get_file_info(FileSelector(folder)):
                    if info.is_file and info.path not in written:
                        files.delete_file(info.path)
            batch = "" if self.overwrite else f"-{uuid.uuid4().hex[:8]}"
            for temporary, part in written.items():
                files.move(temporary, f"{folder}/part-{part:05d}{batch}")

    def abort(self, messages: list) -> None:
        for message in messages:
            for at, temporary in message.temporary.items() if message else ():
                opened(self.paths[at])[0].delete_file(temporary)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftflow_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def read(spark: SparkSession, patterns: str | list[str], key: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None, by_file: bool = False, tasks: int | None = None) -> DataFrame:
    """``key, value, file`` of each record; ``key`` and ``value`` may decode the bytes to typed columns.

    ``by_file`` packs the files into ``tasks`` and begins each with a row of nulls, as per-file hooks need.
    """
    spark.dataSource.register(RecordFiles)
    found = matching(spark, patterns)
    options = {"files": json.dumps([(f.path, f.size) for f in found]), "tasks": (tasks or task_count(spark, found)) if by_file else 0}
    df = spark.read.format("weftflow_records").options(**options).load()
    if key is not None:
        df = df.withColumn("key", key(df["key"]))
    return df if value is None else df.withColumn("value", value(df["value"]))


def write(df: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "overwrite") -> None:
    """One file per partition, rows in their order; nulls are empty."""
    write_routed(df.select(F.lit(0).alias("at"), df[key].alias("key"), df[value].alias("value")), [path], mode)


def write_routed(df: DataFrame, paths: list[str], mode: str = "overwrite") -> None:
    """One pass over ``df(at, key, value)``: rows go to the path of number ``at``; every path is made."""
    df.sparkSession.dataSource.register(RecordFiles)
    rows = df.select("at", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    rows.write.format("weftflow_records").mode(mode).option("paths", json.dumps(paths)).save()
