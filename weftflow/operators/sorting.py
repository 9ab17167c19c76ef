"""Rows in key order in bounded memory, for classes that run in Python workers.

Rows are sorted a run at a time. All runs but the last go to files in the folders that Spark keeps for its own
shuffles, and all are merged a block at a time, so memory grows with the logarithm of the rows only. The files
have no names, so they are gone with the task, however it ends.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of rows that are sorted at once, bytes of a run that are read back at once, runs that are merged into one.
RUN, BLOCK, FAN = 32 << 20, 256 << 10, 32
#: Bytes that a row takes beside its key and value.
ROW = 16


def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches of two string or binary columns, in byte order of the first, which has no nulls.

    Rows of equal keys are in no set order. Columns become large ones, whose blocks may be joined at any size.
    """
    levels: list[list[BinaryIO]] = []  # runs by how often they were merged

    def add(run: BinaryIO, level: int) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == FAN:
            full, levels[level] = levels[level], []
            add(_written(_merged([_read(r) for r in full])), level + 1)

    held, size = [], 0
    for batch in batches:
        batch = _large(batch)
        if held and size + batch.nbytes > RUN:
            add(_written(_blocks(_arranged(held))), 0)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
        held.append(batch)
        size += batch.nbytes
    last = _blocks(_arranged(held)) if held else iter(())
    held = []
    yield from _merged([*(_read(run) for level in levels for run in level), last]) if levels else last


def _large(batch: pa.RecordBatch) -> pa.RecordBatch:
    wide = [pa.large_string() if pa.types.is_string(c.type) else pa.large_binary() if pa.types.is_binary(c.type) else c.type for c in batch.columns]
    return pa.record_batch([c.cast(t) for c, t in zip(batch.columns, wide)], names=batch.schema.names)


def _arranged(batches: list[pa.RecordBatch]) -> pa.Table:
    """The rows of batches in key order; each distinct key is compared as a string, its rows as numbers."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    keys = pc.dictionary_encode(pa.concat_arrays(rows.column(0).chunks))
    ranks = np.empty(len(keys.dictionary), dtype=np.int32)
    ranks[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(ranks), dtype=np.int32)
    return rows.take(pa.array(np.argsort(ranks[keys.indices.to_numpy()])))


def _blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows cut into batches of about ``BLOCK`` bytes, which a row may exceed."""
    rows = rows.combine_chunks()
    lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in rows.columns]
    ends = np.cumsum(sum(lengths) + ROW)
    edges = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(rows)]
    for a, b in zip(edges, edges[1:]):
        yield from rows.slice(a, b - a).to_batches()


def _folder() -> str | None:
    """One of the executor's folders, a different one for each process in turn."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return folders[os.getpid() % len(folders)] if folders else None


def _written(blocks: Iterator[pa.RecordBatch]) -> BinaryIO:
    """A run as a file without a name."""
    file = tempfile.TemporaryFile(dir=_folder())
    first = next(blocks)
    with pa.ipc.new_stream(file, first.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(first)
        for block in blocks:
            out.write_batch(block)
    file.seek(0)
    return file


def _read(run: BinaryIO) -> Iterator[pa.RecordBatch]:
    with run, pa.ipc.open_stream(run) as blocks:
        yield from blocks


def _merged(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted runs. Each round takes the rows up to the least of the keys that end a run's block, so
    it uses up a block at least, and all rows still to come have that key or larger ones."""
    heads = [(block, run) for run in runs if (block := next(run, None)) is not None]
    while heads:
        bound = min(block.column(0)[-1].as_py() for block, _ in heads)
        taken, left = [], []
        for block, run in heads:
            keys = block.column(0)
            n = bisect_right(range(len(keys)), bound, key=lambda k: keys[k].as_py())
            if n:
                taken.append(block.slice(0, n))
            rest = block.slice(n) if n < len(block) else next(run, None)
            if rest is not None:
                left.append((rest, run))
        heads = left
        yield from _blocks(_arranged(taken))
