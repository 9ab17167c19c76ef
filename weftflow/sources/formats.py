"""Readers and writers by format name, and output to several channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records, text

#: Readers by name: (spark, patterns, by_file, **options) to ``key, value, file``.
READERS: dict[str, Callable[..., DataFrame]] = {}
#: Writers by name: (frame with key and value, path).
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}
#: Writers to several paths in one pass: (frame with at, key and value, paths).
ROUTED: dict[str, Callable[[DataFrame, list[str]], None]] = {}


def register_reader(name: str, read: Callable[..., DataFrame]) -> None:
    READERS[name] = read


def register_writer(name: str, write: Callable[[DataFrame, str], None], routed: Callable[[DataFrame, list[str]], None] | None = None) -> None:
    """A format's writer; without a ``routed`` one, several paths are several passes."""
    WRITERS[name] = write
    if routed is None:
        ROUTED.pop(name, None)
    else:
        ROUTED[name] = routed


def reader(name: str) -> Callable[..., DataFrame]:
    """The reader of a format, by its exact name; KeyError if there is none."""
    if name not in READERS:
        raise KeyError(f"no reader for format {name!r}")
    return READERS[name]


def writer(name: str) -> Callable[[DataFrame, str], None]:
    if name not in WRITERS:
        raise KeyError(f"no writer for format {name!r}")
    return WRITERS[name]


def _records(spark: SparkSession, patterns: str | list[str], by_file: bool = False, **options) -> DataFrame:
    return records.read(spark, patterns, by_file=by_file, tasks=options.get("tasks"))


def _text(spark: SparkSession, patterns: str | list[str], by_file: bool = False, **options) -> DataFrame:
    return text.read_text(spark, patterns, by_file=by_file, **options)


register_reader("text", _text)
register_writer("text", lambda df, path: text.write_text(df, path), lambda df, paths: text.write_routed(df, paths))
for _name in ("protofile", "recordio"):  # two names of one format
    register_reader(_name, _records)
    register_writer(_name, lambda df, path: records.write(df, path), lambda df, paths: records.write_routed(df, paths))


def write_routed(df: DataFrame, format_name: str, paths: list[str]) -> None:
    """Write the rows of ``df(at, key, value)`` to the path of number ``at``: in one pass, if the format can."""
    write = writer(format_name)
    if len(paths) == 1:
        write(df.select("key", "value"), paths[0])
    elif format_name in ROUTED:
        ROUTED[format_name](df, paths)
    else:
        for number, path in enumerate(paths):
            write(df.where(F.col("at") == number).select("key", "value"), path)


def checked_channels(df: DataFrame, channels: int) -> DataFrame:
    """``df``, which fails at run time if its ``channel`` is null or outside [0, channels)."""
    good = F.col("channel").between(0, channels - 1)
    wrong = F.raise_error(F.concat(F.lit(f"channel outside [0, {channels}): "), F.coalesce(F.col("channel").cast("string"), F.lit("null"))))
    return df.withColumn("channel", F.when(good, F.col("channel")).otherwise(wrong).cast("int"))


def write_channels(df: DataFrame, format_name: str, paths: list[str]) -> None:
    """Write the rows of each ``channel`` to the path of its number; every path is made, even if empty."""
    write_routed(checked_channels(df, len(paths)).withColumnRenamed("channel", "at"), format_name, paths)


def write_by_channel(df: DataFrame, channels: int, path: str) -> None:
    """Text of all channels in one pass, to ``path/channel=N``."""
    df = checked_channels(df, channels)
    df.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), "channel").write.mode("overwrite").partitionBy("channel").text(path)
