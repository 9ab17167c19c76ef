"""Helpers that several operators of this subpackage share.

* :class:`Tables`: tables of a run in the folder that all executors see, and :func:`clean`;
* :func:`joined`: joins in which no frequent key fills a task;
* :func:`without` and :func:`only`: rows of a table less those that a list names, or only those, past a Bloom
  filter of the list, so that most rows never move;
* :func:`slices` and :func:`chunks`: bounded pieces of batches and of long texts;
* :class:`UnitCache`: a bounded memo from white-space delimited pieces of text to packed integers.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import shared_dir

#: Bytes of text that a Python worker handles at once (one longer text is handled alone, and whole).
SLICE_BYTES = 2 << 20
#: A key with more than one in so many rows is joined by broadcast: there can't be more such keys than this.
HOT = 1000
#: Rows of a key that are never too many for a task.
FEW = 100
#: Share of rows that pass a Bloom filter without being listed.
FALSE_HITS = 0.02
_SPACE = re.compile(rb"[ \t-\r]")
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables, in the shared one."""
    return f"{shared_dir(spark)}/weftflow-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing uses yet."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`written` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder; results not yet read are lost."""
    remove(spark, run_dir(spark))


class Tables:
    """The tables that one call writes. :meth:`done` deletes those that its result doesn't read, or all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.spent, self.read = spark, [], []

    def write(self, df: DataFrame, name: str, read_by_result: bool = False) -> DataFrame:
        table, path = written(df, name)
        (self.read if read_by_result else self.spent).append(path)
        return table

    def done(self, everything: bool = False) -> None:
        remove(self.spark, *self.spent, *(self.read if everything else ()))
        self.spent = []
        self.read = [] if everything else self.read


def joined(many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", rows: str = "rows") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key and the number of its ``rows`` in ``many``.

    Keys with more than one in ``HOT`` rows would fill a task of an exchange. There are fewer than ``HOT`` of
    them, so their rows of ``one`` are broadcast whatever the input's size, and only the others are exchanged.
    ``how`` is inner, left, left_semi or left_anti. Both sides are read twice: they should be written tables.
    """
    sizes = one.agg(F.sum(rows).alias("total"), F.max(rows).alias("most")).first()
    least = max(FEW, (sizes.total or 0) // HOT)
    if (sizes.most or 0) <= least:
        return many.join(one.drop(rows), on, how)
    hot, cold = one.where(F.col(rows) > least).drop(rows), one.where(F.col(rows) <= least).drop(rows)
    rest = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    if how == "left_anti":
        return rest
    return many.join(F.broadcast(hot), on, "inner" if how == "left" else how).unionByName(rest)


def bloom(listed: DataFrame, column: str, rows: int) -> Callable[[Column], Column]:
    """A test whether a long may be among the ``rows`` longs of ``column``: never false for one that is.

    The filter has some 8 bits a row and never more than Spark's own bound for such filters (8 MB by default),
    so that it travels with the plan; past that bound it lets more rows through, and never fewer.
    """
    jvm = listed.sparkSession._jvm
    made = listed.coalesce(64)._jdf.stat().bloomFilter(column, max(1, rows), FALSE_HITS)
    out = jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    utils, expressions = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    data = utils.expression(F.lit(bytearray(out.toByteArray()))._jc)

    def test(value: Column) -> Column:
        return type(value)(utils.column(expressions.BloomFilterMightContain(data, utils.expression(value._jc))))

    return test


def mark_of(text: Column) -> Column:
    """Tells texts of one document id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


_ROW_KEY = ["id_key", "no_id", "mark"]


def _row_key(doc_id: Column, mark: Column) -> list[Column]:
    """Columns without nulls that tell rows apart by document id, null too, and text."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("id_key"), doc_id.isNull().alias("no_id"), mark.alias("mark")]


def _split(df: DataFrame, listed: DataFrame, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the list surely lacks, and the others as ``row`` with their keys."""
    test = bloom(listed.select(F.xxhash64("id_key", "mark").alias("h")), "h", rows)
    doc_id, mark = F.col(id_col), mark_of(F.col(text_col))
    maybe = test(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), mark))
    return df.where(~maybe), df.where(maybe).select(*_row_key(doc_id, mark), F.struct("*").alias("row"))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_ROW_KEY).agg(F.first("row").alias("row"))


def without(df: DataFrame, listed: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` less the rows that ``listed(doc_id, mark, stays, rows)`` names.

    All ``rows`` of a listed document id and text go, or all but one where it ``stays``. Rows that don't pass a
    Bloom filter of the list are never moved; those that do are joined with the list itself, so the result is
    exact whatever the filter lets through. ``listed`` has distinct keys. ``df`` is read more than once, so it must
    be a table or a plan that gives the same rows again.
    """
    keys = listed.select(*_row_key(F.col("doc_id"), F.col("mark")), "stays", "rows")
    keys = tables.write(keys, "listed-rows", read_by_result=True)
    found = keys.agg(F.count("*").alias("n"), F.count_if("stays").alias("stay")).first()
    if not found.n:
        return df
    clear, maybe = _split(df, keys, found.n, id_col, text_col)
    out = clear.unionByName(joined(maybe, keys.drop("stays"), _ROW_KEY, "left_anti").select("row.*"))
    if found.stay:
        out = out.unionByName(_first(joined(maybe, keys.where("stays").drop("stays"), _ROW_KEY, "left_semi")).select("row.*"))
    return out


def only(df: DataFrame, listed: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each document id and text of ``listed(doc_id, mark)``, which are distinct."""
    keys = tables.write(listed.select(*_row_key(F.col("doc_id"), F.col("mark")), F.lit(1).alias("rows")), "listed-rows", read_by_result=True)
    n = keys.count()
    if not n:
        return df.limit(0)
    _, maybe = _split(df, keys, n, id_col, text_col)
    return _first(maybe.join(keys.drop("rows"), _ROW_KEY, "left_semi")).select("row.*")


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the machine; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that each piece holds about ``most`` bytes of ``column`` (string or binary)."""
    array = batch.column(batch.schema.get_field_index(column))
    if len(array) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
        trim()


def chunks(data: bytes, most: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes that end before ASCII white space (a longer word stays whole)."""
    at = 0
    while at < len(data):
        to = at + most
        if to < len(data):
            found = _SPACE.search(data, to)
            to = found.start() if found else len(data)
        yield data[at:to]
        at = to


class UnitCache:
    """Maps pieces of text to packed values, computing each distinct piece once while it is remembered.

    ``compute`` gets a list of new pieces and returns as many ``bytes``. When the memo holds ``most`` pieces
    it becomes the older of two generations and the one before is forgotten, so memory is bounded; results
    never depend on what is held.
    """

    def __init__(self, compute: Callable[[list], list[bytes]], most: int = 100_000, longest: int = 256):
        self.compute, self.most, self.longest = compute, most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []

    def ready(self, groups: list[list]) -> dict:
        """A mapping that holds all pieces of all groups, until the next call; long pieces are held no longer."""
        for piece in self.long:
            del self.young[piece]
        wanted = set().union(*groups)
        fresh = wanted.difference(self.young)
        if len(self.young) + len(fresh) > self.most:
            self.old, self.young, fresh = self.young, {}, wanted
        known = fresh & self.old.keys()
        self.young.update((piece, self.old[piece]) for piece in known)
        new = list(fresh - known)
        self.young.update(zip(new, self.compute(new)))
        self.long = [piece for piece in new if len(piece) > self.longest]
        return self.young


def list_array(packed: pa.BinaryArray, kind: str, arrow: pa.DataType) -> pa.ListArray:
    """Arrow lists from the packed integers of each row."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(offsets // size), pa.array(values.view(kind)).cast(arrow))
