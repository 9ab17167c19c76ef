"""Mappers: map-side work as Column expressions, or as Python classes with per-file hooks.

Use expressions where they can say it (:func:`emit`): Catalyst then sees the whole plan, combines before the
shuffle and prunes columns. A :class:`Mapper` runs arbitrary code over Arrow batches in Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import js_hash_of, js_hashes_of
from .registry import mapper as mappers
from .routing import spread

#: Rows that Python sends back at once.
BATCH = 4096


@dataclass(frozen=True)
class Context:
    """What a mapper or reducer may ask about its job."""

    input_format: str = "text"
    output_format: str = "text"
    shards: int = 1
    map_only: bool = False
    channels: int = 1


class Mapper:
    """Subclasses define :meth:`map` and may define the hooks and :meth:`shard`.

    :meth:`start` and :meth:`flush` run once for each input file, empty ones too, and may emit. One mapper
    object serves all files of a partition, so its state goes on from file to file. Emitted keys get the default
    shard a batch at a time, unless a subclass has a :meth:`shard` of its own.
    """

    context = Context()
    current_file = ""
    #: Stands for the default shard, which is computed later.
    DEFAULT = -(1 << 40)

    def __init__(self):
        self.emitted: list[tuple[int | None, object, object]] = []

    def start(self) -> None: ...

    def map(self, key, value) -> None:
        raise NotImplementedError

    def flush(self) -> None: ...

    def shard(self, key, shards: int) -> int:
        return js_hash_of(key) % shards

    def output(self, key, value) -> None:
        own = type(self).shard is not Mapper.shard and not self.context.map_only
        self.emitted.append((self.shard(key, self.context.shards) if own else Mapper.DEFAULT, key, value))

    def output_to_shard(self, shard: int, key, value) -> None:
        if self.context.map_only:
            raise RuntimeError("a map-only job has no shards")
        if not 0 <= shard < self.context.shards:
            raise ValueError(f"shard outside [0, {self.context.shards}): {shard}")
        self.emitted.append((shard, key, value))

    def output_to_all_shards(self, key, value) -> None:
        if self.context.map_only:
            raise RuntimeError("a map-only job has no shards")
        self.emitted += [(shard, key, value) for shard in range(self.context.shards)]


def objects(column: pa.Array) -> list:
    """Python objects of a string, binary or whole-number column; numbers must not be null."""
    return column.to_numpy(zero_copy_only=False).tolist()


def run_mapper(df: DataFrame, mapper: str | Callable[[], Mapper], context: Context, by_file: bool = False, kind: str = "string") -> DataFrame:
    """``shard, key, value`` of what a mapper (a class or a registered name) emits for ``df(key, value, file)``.

    The hooks run whenever the file changes within a partition. With ``by_file`` a row with a null key marks
    the start of each file, as readers by file give them, so that the hooks also run for files without rows;
    if there are no rows at all in a partition they run once, for an unnamed file. ``kind`` is the type of keys
    and values, string or binary. ``shard`` is null in a map-only job. Null keys and values count as empty.
    Rows that belong to no file are dealt to all cores where the input has fewer splits.
    """
    create = mappers.find(mapper) if isinstance(mapper, str) else mapper
    arrow = pa.string() if kind == "string" else pa.binary()
    empty = "" if kind == "string" else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = create(), None
        own.context = context
        own.emitted = []

        def sent() -> pa.RecordBatch:
            shards, keys, values = zip(*own.emitted) if own.emitted else ((), (), ())
            own.emitted = []
            keys = pa.array(keys, arrow)
            if context.map_only:
                shards = pa.nulls(len(keys), pa.int32())
            else:
                shards = np.array(shards, dtype=np.int64)
                default = shards == Mapper.DEFAULT
                if default.any():
                    shards = np.where(default, js_hashes_of(keys) % np.uint32(context.shards), shards)
                shards = pa.array(shards.astype(np.int32))
            return pa.record_batch([shards, keys, pa.array(values, arrow)], names=["shard", "key", "value"])

        def opened(name: str) -> None:
            nonlocal file
            if file is not None:
                own.flush()
            file = own.current_file = name
            own.start()

        for batch in batches:
            files = objects(batch.column(2))
            marks = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)).tolist() if by_file else []
            marks = set(marks)
            for k, (key, value, at) in enumerate(zip(objects(batch.column(0)), objects(batch.column(1)), files)):
                if k in marks:
                    opened(at)
                    continue
                if at != file:
                    opened(at)
                own.map(key, value)
                if len(own.emitted) >= BATCH:
                    yield sent()
        if file is None and by_file:
            own.start()
        if file is not None or by_file:
            own.flush()
        yield sent()

    file = F.coalesce(F.col("file"), F.lit("")) if "file" in df.columns else F.lit("")
    parts = [F.coalesce(F.col(c).cast(kind), F.lit(empty).cast(kind)).alias(c) for c in ("key", "value")]
    read = df.select(*parts, file.alias("file"), F.col("key").isNull().alias("mark"))
    return (read if by_file or "file" in df.columns else spread(read)).mapInArrow(run, f"shard int, key {kind}, value {kind}")


def emit(df: DataFrame, key: Column, value: Column, where: Column | None = None) -> DataFrame:
    """``key, value`` as expressions over ``df``; a generator such as ``explode`` makes several rows of one."""
    return (df if where is None else df.where(where)).select(key.alias("key"), value.alias("value"))


def union_of(*mapped: DataFrame) -> DataFrame:
    """The outputs of several mappers, which feed the same reducers."""
    first, *rest = mapped
    for other in rest:
        first = first.unionByName(other)
    return first


def passes(df: DataFrame, number: int) -> DataFrame:
    """Every row once for each pass over the input, with the ``pass`` number."""
    return df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
