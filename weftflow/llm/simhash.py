"""SimHash near-duplicates by pigeonhole blocks (operator 6).

A fingerprint has 64 bits, of which bit b is set if more than half of the text's shingle hashes have it.
Fingerprints that differ in at most ``BITS`` = 3 bits are linked; components of links are the classes.

Fingerprints are split into 5 blocks. Three differing bits touch at most three, so close pairs
share two blocks: distinct fingerprints meet under each of the ten pairs of blocks, 25 or 26 bits that must
agree, and are then compared. Equal fingerprints are one node, however many documents have them.

A block key with more than ``LIMIT`` distinct fingerprints isn't compared in one task: its fingerprints go on
to the next finer split, of 8 blocks of which 5 must agree, and from there, under keys that are still crowded,
to 16 blocks of which 13 must agree. Under such a key at most 2 ** 12 distinct fingerprints exist at all, so
every group is bounded, whatever the data, and no link is lost. Groups give a spanning forest of their
links, never all pairs.

Long texts are hashed in pieces of ``CHUNK`` bytes whose bit counts are added, so memory doesn't grow with them.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows are
repeated in the result; null document ids take part, and a class of nothing but null ids has a null
``component_id``; other columns are left out, so their names can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from .common import Tables, chunks, joined, mark_of, slices, without
from .components import components
from .pieces import release

SHINGLE = 3
BITS = 3
#: Splits by fineness: how many blocks, and how many of them must agree.
LEVELS = ((5, 2), (8, 5), (16, 13))
LIMIT = 4096
SEED = 42
CHUNK = 1 << 18
#: The 64-bit sum of eight counters of a byte each, by the byte whose bits are counted (high bit first).
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Big-endian XXH64 of each shingle of the words, of all of them where they are fewer than ``size``."""
    if not words:
        return []
    joined_words = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_digest(joined_words, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined_words, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) + 1 - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined_words)]
    digest = xxhash.xxh64_digest
    return [digest(joined_words[a:b], SEED) for a, b in zip(starts, ends)]


def parts(text: bytes, size: int = SHINGLE) -> Iterator[list[bytes]]:
    """The shingle hashes of a text, in pieces of bounded size; each but the first begins with the words that
    its shingles share with the one before."""
    carried: list[bytes] = []
    before = 0
    for piece in chunks(text, CHUNK):
        words = carried + piece.lower().split()
        if len(words) >= size:
            yield shingle_hashes(words, size)
            before += 1
            carried = words[len(words) - size + 1 :] if size > 1 else []
        else:
            carried = words
    if not before:
        yield shingle_hashes(carried, size)


def simhashes(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The fingerprints of texts, as unsigned 64-bit integers."""
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, list[bytes]]] = []

    def add() -> None:
        sizes = np.fromiter((len(h) for _, h in held), dtype=np.int64, count=len(held))
        data = np.frombuffer(b"".join([h for _, one in held for h in one]), dtype=np.uint8).reshape(-1, 8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # sums of at most 255 rows, which fit in a counter of a byte, then sums of those
        cuts = np.unique(np.concatenate([starts, np.arange(0, len(data), 255)]))
        sums = np.add.reduceat(_LANES[data], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
        rows = [k for k, _ in held]
        np.add.at(counts, rows, np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0))
        np.add.at(total, rows, sizes)
        held.clear()

    shingles = 0
    for k, text in enumerate(texts):
        for hashes in parts(text, size):
            if hashes:
                held.append((k, hashes))
                shingles += len(hashes)
            if shingles >= CHUNK // 4:
                add()
                shingles = 0
    if held:
        add()
    return np.packbits((2 * counts > total[:, None]).astype(np.uint8), axis=1).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp``: the fingerprint of each whole text as a signed long, and a mark of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = simhashes(part.column(2).to_pylist(), size).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found)], names=["doc_id", "mark", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("doc_id"), mark_of(F.col(text_col)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return spread(read).mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def masks(blocks: int, kept: int) -> list[int]:
    """64-bit masks of all choices of ``kept`` of so many blocks, as signed numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [(m - (1 << 64) if m >> 63 else m) for m in (sum(c) for c in combinations(each, kept))]


def keyed(fps: DataFrame, chosen: list[int]) -> DataFrame:
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(chosen)))
    return fps.select(F.explode(keys).alias("key"), "fp")


def forest(fps: np.ndarray) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Edges of a spanning forest of the links between distinct fingerprints."""
    rest = fps.view(np.uint64)  # of signed numbers, bits would be counted in the absolute value
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                yield from ((at, x) for x in found)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the fingerprints of a key, from rows ordered by key; keys have bounded groups."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        bits = fps.view(np.uint64)
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        for lag in range(1, min(8, int(sizes.max(initial=0)))):
            close = (keys[lag:] == keys[:-lag]) & small[lag:] & (np.bitwise_count(bits[lag:] ^ bits[:-lag]) <= BITS)
            a.append(fps[:-lag][close])
            b.append(fps[lag:][close])
        more = [e for k in np.flatnonzero(sizes > 8) for e in forest(fps[first[k] : first[k] + sizes[k]])]
        if more:
            pairs = np.array(more, dtype=np.uint64).view(np.int64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (a, b)], schema=_EDGES)

    keys = fps = np.zeros(0, dtype=np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        if len(keys) < 1 << 16:
            continue
        whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if whole:
            yield edges(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield edges(keys, fps)


def links(fps: DataFrame, limit: int = LIMIT, tables: Tables | None = None) -> DataFrame:
    """Edges ``a, b`` that tie together all linked fingerprints of ``fps(fp)``, which are distinct."""
    tables = tables or Tables(fps.sparkSession)
    found, rest = [], fps
    for blocks, agree in LEVELS:
        keys = rows = keyed(rest, masks(blocks, agree))
        crowded = None
        if (blocks, agree) != LEVELS[-1]:
            hot = tables.write(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > limit), "hot-blocks")
            if not hot.isEmpty():
                rows = joined(keys, hot, ["key"], "left_anti")
                crowded = tables.write(joined(keys, hot, ["key"], "left_semi").select("fp").distinct(), "crowded")
        found.append(rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long"))
        if crowded is None:
            break
        rest = crowded
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def classed(df: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, mark, fp, component_id`` for each row of ``df``."""
    own = Tables(df.sparkSession)
    docs = tables.write(fingerprints(df, id_col, text_col), "fingerprints", read_by_result=True)
    least = own.write(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct-fingerprints")
    tied = components(links(least.select("fp"), limit, own))
    rooted = own.write(least.join(tied, least.fp == tied.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    classes = own.write(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("texts")), "classes")
    of = tables.write(joined(rooted, classes, ["root"], rows="texts").select("fp", "rows", "component_id"), "classes-of", read_by_result=True)
    own.done()
    return joined(docs, of, ["fp"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: ``doc_id, fingerprint, component_id``."""
    rows = classed(df, Tables(df.sparkSession), id_col, text_col, limit)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each class, with all columns: that of the smallest document id.

    Where several texts of a class have that id, each stays, but of rows with equal texts too one stays. Of
    rows with a null id one for each text stays where their class has no other id; where it has, they go.
    """
    tables, own = Tables(df.sparkSession), Tables(df.sparkSession)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = classed(df, own, id_col, text_col).groupBy("doc_id", "mark").agg(F.bool_or(first).alias("stays"), F.count("*").alias("rows"))
    kept = without(df, rows.where("not stays or rows > 1"), tables, id_col, text_col)  # has written the list
    own.done(everything=True)
    return kept
