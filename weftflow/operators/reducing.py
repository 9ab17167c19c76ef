"""Reducers: aggregations as Column expressions, or Python classes with per-shard hooks.

Use :func:`fold` and :func:`grouped` (or plain ``groupBy().agg()``) where they can say it: both kinds of
reduction then are the same plan, with partial aggregation before the shuffle and spilling after it. A
:class:`BatchReducer` or :class:`IncrementalReducer` runs arbitrary code in Python workers over rows that
Spark has dealt to shards. The workers sort them by key (:mod:`.sorting`): a shard may have any number of rows,
and a key's values stream past, so neither needs to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import BATCH, Context, objects
from .registry import reducer_class
from .routing import to_shards
from .sorting import in_order

#: The channel of the numbers of keys.
KEYS = -1


class Reducer:
    """:meth:`start` and :meth:`flush` run once for each shard, also where it has no keys, and may emit."""

    context = Context()

    def __init__(self):
        self.emitted: list[tuple[int, object, object]] = []

    def start(self) -> None: ...

    def flush(self) -> None: ...

    def output(self, key, value) -> None:
        self.emitted.append((0, key, value))

    def output_to_channel(self, channel: int, key, value) -> None:
        if not 0 <= channel < self.context.channels:
            raise ValueError(f"channel outside [0, {self.context.channels}): {channel}")
        self.emitted.append((channel, key, value))

    def run_key(self, key, values: Iterator) -> None:
        raise NotImplementedError


class BatchReducer(Reducer):
    """:meth:`reduce` gets each key once, in byte order, with an iterator over its values in no set order.

    Values that it doesn't read are skipped.
    """

    def reduce(self, key, values: Iterator) -> None:
        raise NotImplementedError

    def run_key(self, key, values: Iterator) -> None:
        self.reduce(key, values)


class IncrementalReducer(Reducer):
    """A fold: :meth:`begin_reduce` makes a state of a key's first value, :meth:`partial_reduce` returns the
    state after another one, :meth:`end_reduce` emits; keys end in byte order."""

    def begin_reduce(self, key, value):
        raise NotImplementedError

    def partial_reduce(self, key, value, state):
        raise NotImplementedError

    def end_reduce(self, key, state) -> None:
        raise NotImplementedError

    def run_key(self, key, values: Iterator) -> None:
        state = self.begin_reduce(key, next(values))
        for value in values:
            state = self.partial_reduce(key, value, state)
        self.end_reduce(key, state)


def run_reducer(mapped: DataFrame, reducer: str | Callable[[], Reducer] | list, context: Context, incremental: bool = False, kind: str = "string", count_keys: bool = False) -> DataFrame:
    """``shard, channel, key, value`` of what reducers emit for ``mapped(shard, key, value)``.

    ``reducer`` is a class or a registered name, or a list of them, one for each shard. One row that no
    reducer sees goes to every shard, so that the hooks run where there are no keys. With ``count_keys`` each
    shard adds a row in channel ``KEYS`` with the number of keys it reduced.
    """
    kinds = reducer if isinstance(reducer, list) else [reducer] * context.shards
    if len(kinds) != context.shards:
        raise ValueError(f"{len(kinds)} reducers for {context.shards} shards")
    create = [reducer_class(r, incremental) if isinstance(r, str) else r for r in kinds]
    arrow = pa.string() if kind == "string" else pa.binary()
    empty = "" if kind == "string" else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((batch for batch in batches if len(batch)), None)
        if first is None:
            return
        shard = first.column(0)[0].as_py()  # a partition is a shard
        own = create[shard]()
        own.context, own.emitted = context, []
        own.start()
        seen = 0

        def rows() -> Iterator[pa.RecordBatch]:
            """Keys and values, without the row that stands for the shard."""
            for batch in chain([first], batches):
                batch = batch.select(["key", "value"])
                yield batch.filter(batch.column(0).is_valid()) if batch.column(0).null_count else batch

        def runs() -> Iterator[tuple]:
            """(key, values) of each run of one key in a batch."""
            for batch in in_order(rows()):
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                values = objects(batch.column(1))
                edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for a, b in zip(edges, edges[1:]):
                    if a < b:
                        yield keys[a], values[a:b]

        def sent() -> pa.RecordBatch:
            channels, keys, values = zip(*own.emitted) if own.emitted else ((), (), ())
            own.emitted = []
            columns = [pa.array(np.full(len(keys), shard, dtype=np.int32)), pa.array(channels, pa.int32()), pa.array(keys, arrow), pa.array(values, arrow)]
            return pa.record_batch(columns, names=["shard", "channel", "key", "value"])

        for key, same in groupby(runs(), key=itemgetter(0)):  # a key may go on in the next batch
            values = chain.from_iterable(map(itemgetter(1), same))
            seen += 1
            own.run_key(key, values)
            if len(own.emitted) >= BATCH:
                yield sent()
        own.flush()
        if count_keys:
            own.emitted.append((KEYS, empty, str(seen) if kind == "string" else str(seen).encode()))
        yield sent()

    spark = mapped.sparkSession
    null = F.lit(None).cast(kind)
    marks = spark.range(context.shards).select(F.col("id").cast("int").alias("shard"), null.alias("key"), null.alias("value"))
    parts = [F.coalesce(F.col(c).cast(kind), F.lit(empty).cast(kind)).alias(c) for c in ("key", "value")]
    dealt = to_shards(mapped.select("shard", *parts).unionByName(marks), context.shards, key=None)
    return dealt.mapInArrow(run, f"shard int, channel int, key {kind}, value {kind}")


def grouped(df: DataFrame, *aggregates: Column, key: str = "key") -> DataFrame:
    """One row per key with the given aggregates."""
    return df.groupBy(key).agg(*aggregates)


#: Values that a fold with a ``combine`` gathers in one row.
PART = 10_000


def fold(
    df: DataFrame,
    zero: Column,
    merge: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column] | None = None,
    combine: Callable[[Column, Column], Column] | None = None,
    key: str = "key",
    value: str = "value",
) -> DataFrame:
    """``key, value``: a fold over a key's values, for folds that no aggregate expresses.

    With ``combine``, which joins two states, about ``PART`` values at a time are folded, and then their states:
    a key may have any number of values, which are folded in no set order. Without it a key's values are folded
    in value order and gathered in one row, so that is for keys of bounded size. Sums, counts, extremes and
    other algebraic folds belong in :func:`grouped`.
    """

    def folded(states: Column, step: Callable[[Column, Column], Column], last: bool) -> Column:
        return F.aggregate(states, zero, step, finish) if finish and last else F.aggregate(states, zero, step)

    if combine is None:
        return df.groupBy(key).agg(folded(F.sort_array(F.collect_list(value)), merge, True).alias("value"))
    # numbers of rows within their partitions, which cut a partition's rows into parts
    part = F.expr(f"monotonically_increasing_id() div {PART}")
    parts = df.select(F.col(key).alias("key"), F.col(value).alias("value"), part.alias("part")).groupBy("key", "part")
    states = parts.agg(folded(F.collect_list("value"), merge, False).alias("state"))
    return states.groupBy("key").agg(folded(F.collect_list("state"), combine, True).alias("value")).withColumnRenamed("key", key)
