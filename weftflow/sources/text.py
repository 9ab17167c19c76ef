"""Lines of text files with their byte offsets, and the text sink.

:func:`read_text` gives a row for each line: ``key`` is the file's name, a hyphen and the line's byte offset
in ten digits; ``value`` is the line without its newline and without one carriage return before it; ``file``
is the file's name. Lines are bytes decoded as UTF-8, bad sequences replaced.

Large files are split by byte ranges: a task starts after the first newline in its range and reads on to the
end of the line that its range ends in, so no line is lost or doubled. ``by_file`` leaves files whole, as per-file
hooks need, and packs them into tasks; every file then begins with a row whose key and value are null.

``strict`` reproduces a line buffer of ``max_line`` bytes, whole files at a time: a line longer than the buffer
holds becomes as many empty values as buffers it fills, each with its own offset, and so does an unterminated
last line. A NUL byte hides the rest of its line from the buffer, so that line and the next are empty values. By
default all such lines are kept whole.

:func:`read_values` gives values only, with Spark's own reader, in the JVM.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .paths import InputFile, matching, opened, plain

SCHEMA = "key string, value string, file string"
#: Bytes read at once, and bytes of whole files that a task may be given.
BUFFER = 1 << 20
TASK_BYTES = 128 << 20
#: Rows and bytes that are handed to Spark at once.
ROWS, ROW_BYTES = 4096, 8 << 20
_ARROW = pa.schema([("key", pa.string()), ("value", pa.string()), ("file", pa.string())])


class Ranges(InputPartition):
    """Byte ranges of files, (path, start, end), that one task reads in turn."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def lines(stream, start: int, end: int, buffer: int = BUFFER) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes with the newline) of each line that starts in [start, end) of a seekable stream."""
    at = start
    if start:
        stream.seek(start - 1)
        at = start - 1
    held = b""
    skipping = start > 0  # the line that the range starts in belongs to the range before
    while True:
        data = stream.read(buffer)
        if not data:
            break
        *whole, held = (held + data).split(b"\n")
        for line in whole:
            if skipping:
                skipping = False
            elif at >= end:
                return
            else:
                yield at, line + b"\n"
            at += len(line) + 1
        if at >= end and not skipping:
            return
    if held and not skipping and at < end:
        yield at, held


def values(found: Iterator[tuple[int, bytes]], strict: bool = False, max_line: int = 16384) -> Iterator[tuple[int, bytes]]:
    """(offset, value) of each line, without its end, or of each buffer of it."""
    skipping = False  # the buffer's end of a line wasn't seen
    for offset, line in found:
        if not strict:
            value = line.removesuffix(b"\n")
            yield offset, value.removesuffix(b"\r") if len(value) < len(line) else value
            continue
        for k in range(0, len(line), max_line - 1):
            visible = line[k : k + max_line - 1].partition(b"\0")[0]
            whole = visible.endswith(b"\n")
            yield offset + k, b"" if skipping or not whole else visible[:-1].removesuffix(b"\r")
            skipping = not whole


class OffsetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.split = int(options.get("split", 0))
        self.tasks = int(options.get("tasks", 0))
        self.strict = options.get("strict", "false") == "true"
        self.max_line = int(options.get("max_line", 16384))

    def partitions(self) -> list[Ranges]:
        if self.tasks:
            return [Ranges([(path, 0, size) for path, size in some]) for some in packed(self.files, self.tasks)]
        ranges = []
        for path, size in self.files:
            step = max(1, size) if self.strict or not self.split else self.split
            ranges += [Ranges([(path, k, min(size, k + step))]) for k in range(0, max(1, size), step)]
        return ranges

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        keys, lines_read, names, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            text = [None if x is None else x.decode("utf-8", "replace") for x in lines_read]
            out = pa.record_batch([pa.array(keys, pa.string()), pa.array(text, pa.string()), pa.array(names, pa.string())], schema=_ARROW)
            keys.clear(), lines_read.clear(), names.clear()
            return out

        for where, start, end in partition.ranges:
            files, path = opened(where)
            name = plain(where)
            if self.tasks:
                keys.append(None), lines_read.append(None), names.append(name)
            with files.open_input_file(path) as stream:
                for offset, value in values(lines(stream, start, end), self.strict, self.max_line):
                    keys.append(f"{name}-{offset:010d}"), lines_read.append(value), names.append(name)
                    size += len(value)
                    if len(keys) >= ROWS or size >= ROW_BYTES:
                        yield batch()
                        size = 0
        if keys:
            yield batch()


def packed(files: list, tasks: int) -> list[list]:
    """Files, in order, dealt to at most so many tasks of similar size."""
    out: list[list] = [[]]
    share = max(1, sum(size for _, size in files) // tasks)
    held = 0
    for left, (path, size) in zip(range(len(files), 0, -1), files):
        full = held + size // 2 >= share or left <= tasks - len(out)
        if out[-1] and full and len(out) < tasks:
            out.append([])
            held = 0
        out[-1].append((path, size))
        held += size
    return out


class OffsetText(DataSource):
    """Lines with offsets, as a Spark data source."""

    @classmethod
    def name(cls) -> str:
        return "weftflow_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OffsetReader:
        return OffsetReader(self.options)


def task_count(spark: SparkSession, files: list[InputFile]) -> int:
    """Tasks for whole files: as many as there are cores, or more where they hold very much."""
    return min(len(files), max(spark.sparkContext.defaultParallelism, -(-sum(f.size for f in files) // TASK_BYTES)))


def read_text(spark: SparkSession, patterns: str | list[str], by_file: bool = False, strict: bool = False, max_line: int = 16384, split: int = TASK_BYTES, tasks: int | None = None) -> DataFrame:
    """``key, value, file`` for each line of the matching files; ``tasks`` is how many read them ``by_file``."""
    if max_line < 2:
        raise ValueError("max_line must be more than 1")
    spark.dataSource.register(OffsetText)
    found = matching(spark, patterns)
    options = {"files": json.dumps([(f.path, f.size) for f in found]), "split": split, "strict": str(strict).lower(), "max_line": max_line}
    options["tasks"] = (tasks or task_count(spark, found)) if by_file else 0
    return spark.read.format("weftflow_text").options(**options).load()


def read_values(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """``value, file`` for each line, without offsets: newline-separated, one carriage return dropped."""
    paths = [f.path for f in matching(spark, patterns)]
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.regexp_replace("value", r"\r\z", "").alias("value"), current_file().alias("file"))


def current_file() -> Column:
    """The name of the file that a row was read from, without the scheme of local files."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def write_text(df: DataFrame, path: str, value: str = "value", mode: str = "overwrite") -> None:
    """One line per row: the value alone, whole."""
    df.select(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).write.mode(mode).text(path)


def write_routed(df: DataFrame, paths: list[str], value: str = "value") -> None:
    """One pass over ``df(at, value)``: rows go to the path of number ``at``, which is replaced; every path is made.

    Rows are written beside the first path, by number, and each folder is then moved to its place.
    """
    spark = df.sparkSession
    beside = f"{paths[0].rstrip('/')}-{uuid.uuid4().hex}"
    df.select(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"), "at").write.partitionBy("at").text(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(beside)
    files = source.getFileSystem(conf)
    for number, path in enumerate(paths):
        part, place = jvm.org.apache.hadoop.fs.Path(f"{beside}/at={number}"), jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(conf)
        there.delete(place, True)
        if files.exists(part):
            there.mkdirs(place.getParent())
            if files.getUri().equals(there.getUri()):
                files.rename(part, place)
            else:
                jvm.org.apache.hadoop.fs.FileUtil.copy(files, part, there, place, True, conf)
        else:
            there.mkdirs(place)
        there.create(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")).close()
    files.delete(source, True)
