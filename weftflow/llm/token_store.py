"""Token ids in binary shards, Simple-8b packed (operator 1).

A shard is one file of documents in ascending id order::

    "W8B1"                                    magic
    block, block, ...                         the 64-bit words of BLOCK ids each (the last may have fewer),
                                              then the block's escaped values
    int64[blocks, 3]                          byte offset, words and escapes of each block
    int64[documents]                          document ids (0 where null)
    uint8[documents]                          1 where the document id is null
    int64[documents]                          where each document's ids end, counted in the shard
    int64[4]                                  blocks, documents, ids, crc32 of the tables above
    "W8B1"                                    magic

so a reader seeks to any block and decodes it with a few array operations. :func:`write` sorts by document
id over range partitions, one shard each, and returns a manifest; :func:`read` gives the ids back. Shards are
written under a new name by every attempt and only the manifest, which Spark commits, says which count: a
lost executor leaves an orphan, never a wrong or missing shard. The store must be a path that pyarrow's file
systems reach from every executor (a shared mount, hdfs, s3, gs).

Ids are those that the tokenizer gives for the whole text without special tokens added. Where a text contains
the content of one of the tokenizer's added tokens, such as ``<|endoftext|>``, the tokenizer makes its id of it.

Documents of one id are in the order of a hash of their texts, then of the texts, so a hot id fills no shard
unless its texts are equal too.

Edge cases: a null or empty text holds the end id alone; rows with a null document id come first; repeated
rows are repeated documents; document ids must be whole numbers (others are a TypeError: the format keeps 64
bits); long texts are encoded in pieces; other columns are left out, so their names can't clash; an empty table
makes no shard and an empty manifest.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..sources.paths import opened
from . import simple8b
from .common import new_path, slices
from .pieces import PieceCoder, held, packed, release

MAGIC = b"W8B1"
BLOCK = 1 << 16
MANIFEST = "shard int, path string, documents long, ids long"
#: Splits pieces of ASCII as the tokenizer does; others go to it whole.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")

#: The visible characters that byte-level vocabularies write for bytes: themselves, or 256 and up.
_BYTE_CHARACTERS = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
_BLANK = _BYTE_CHARACTERS[32]
#: Below this all versions of Unicode agree on what is a letter.
_SETTLED = "\u0250"


class Encoder:
    """Packed ids of whole texts, by the pieces between which the tokenizer's own pattern always cuts.

    Texts that hold the content of an added token go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.coder = PieceCoder(lambda piece: _ASCII_WORDS.findall(piece) if piece.isascii() else [piece], self.code, pieces=1_000_000, words=150_000)

    def code(self, words: list[str]) -> list[bytes]:
        # the model alone codes words that are surely one match of the tokenizer's own pattern
        out: list[bytes] = []
        wide = []
        for k, w in enumerate(words):
            if w.isascii():
                if w[0] == " " and w[1:].isalpha():
                    w = _BLANK + w[1:]
                elif not w.isalpha():
                    w = w.translate(_BYTE_CHARACTERS)
            elif max(w) < _SETTLED and (w[1:].isalpha() and (w[0] == " " or w[0].isalpha())):
                w = w.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            else:
                wide.append(k)
                out.append(b"")
                continue
            out.append(array("I", [t.id for t in self.tokenize(w)]).tobytes())
        for k, x in zip(wide, self.whole([words[k] for k in wide])):
            out[k] = x
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.StringArray) -> list[bytes]:
        marked = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            marked |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not marked.any():
            return packed(texts, self.coder).to_pylist()
        plain = iter(packed(texts.filter(pa.array(~marked)), self.coder).to_pylist())
        strange = iter(self.whole(texts.filter(pa.array(marked)).to_pylist()))
        return [next(strange) if x else next(plain) for x in marked.tolist()]


def _encoder(tokenizer_path: str) -> Encoder:
    """The worker's encoder for a tokenizer."""
    return held(("tokenizer", tokenizer_path), lambda: Encoder(tokenizer_path))


class ShardWriter:
    """Writes one shard to a binary stream; holds one block of ids and the tables of documents."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.ids: list[np.ndarray] = []
        self.pending = self.total = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.total += len(ids)
        self.ends.append(self.total)
        self.ids.append(ids)
        self.pending += len(ids)
        if self.pending >= BLOCK:
            ids = np.concatenate(self.ids)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k : k + BLOCK])
            self.ids, self.pending = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        words, escaped = simple8b.pack(ids)
        self.blocks.append((self.at, len(words), len(escaped)))
        data = words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.pending:
            self._block(np.concatenate(self.ids))
        tables = np.array(self.blocks, dtype="<i8").tobytes()
        tables += np.array([x or 0 for x in self.doc_ids], dtype="<i8").tobytes()
        tables += np.array([x is None for x in self.doc_ids], dtype="u1").tobytes()
        tables += np.array(self.ends, dtype="<i8").tobytes()
        tail = np.array([len(self.blocks), len(self.ends), self.total, zlib.crc32(tables)], dtype="<i8").tobytes()
        self.out.write(tables + tail + MAGIC)


class Shard:
    """Random access to the documents of a shard in a seekable binary stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 36)
        tail = stream.read(36)
        if tail[32:] != MAGIC:
            raise ValueError("not a shard, or cut short")
        blocks, documents, self.total, crc = np.frombuffer(tail[:32], dtype="<i8").tolist()
        length = 24 * blocks + 17 * documents
        stream.seek(size - 36 - length)
        tables = stream.read(length)
        if zlib.crc32(tables) != crc:
            raise ValueError("damaged shard")
        self.blocks = np.frombuffer(tables, dtype="<i8", count=3 * blocks).reshape(-1, 3)
        at = 24 * blocks
        ids = np.frombuffer(tables, dtype="<i8", count=documents, offset=at).tolist()
        null = np.frombuffer(tables, dtype="u1", count=documents, offset=at + 8 * documents).tolist()
        self.doc_ids = [None if gone else x for x, gone in zip(ids, null)]
        self.ends = np.frombuffer(tables, dtype="<i8", count=documents, offset=at + 9 * documents)

    def block(self, k: int) -> np.ndarray:
        at, words, escaped = self.blocks[k].tolist()
        self.stream.seek(at)
        data = np.frombuffer(self.stream.read(8 * (words + escaped)), dtype="<u8")
        return simple8b.unpack(data[:words], data[words:])

    def ids(self, document: int) -> np.ndarray:
        """The ids of one document, from the blocks that hold them."""
        start = int(self.ends[document - 1]) if document else 0
        end = int(self.ends[document])
        if start == end:
            return np.zeros(0, dtype=np.uint64)
        parts = [self.block(k) for k in range(start // BLOCK, (end - 1) // BLOCK + 1)]
        base = start // BLOCK * BLOCK
        return np.concatenate(parts)[start - base : end - base]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, first position in the shard, ids) of every document, each block decoded once."""
        held, base, upto, k = np.zeros(0, dtype=np.uint64), 0, 0, 0
        start = 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist()):
            if end > upto:
                parts = [held[start - base :]]
                base = start
                while upto < end:
                    parts.append(self.block(k))
                    upto += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield doc_id, start, held[start - base : end - base]
            start = end


def write(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the shards; returns the manifest, read back.

    ``path`` is the store's folder (new); where it is None, one in the shared folder.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        writer = out = None
        files, folder = opened(f"{path}/shards")
        name = f"{shard:06d}-{uuid.uuid4().hex}.w8b"
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                if writer is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(out)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(part.column(1))):
                    writer.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            out.close()
            row = {"shard": [shard], "path": [f"{path}/shards/{name}"], "documents": [len(writer.ends)], "ids": [writer.total]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    kind = df.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"document ids must be whole numbers, not {kind.simpleString()}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    ordered = read.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text")
    ordered.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _laid_out(manifest: DataFrame) -> DataFrame:
    """``path, first`` of each shard: one row, alone in its partition, with the ids of all shards before it.

    The manifest has one row for each shard; only these few rows are gathered.
    """
    rows, base = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.shard):
        rows.append((row.path, base))
        base += row.ids
    shards = manifest.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, path string, first long")
    return (shards.repartitionById(len(rows), F.col("k")) if rows else shards).select("path", "first")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, start, ids) of all documents of the shards in rows of :func:`_laid_out`."""
    release()
    for batch in batches:
        for path, first in zip(*(c.to_pylist() for c in batch.columns)):
            files, at = opened(path)
            with files.open_input_file(at) as stream:
                for doc_id, start, ids in Shard(stream, stream.size()).documents():
                    yield doc_id, first + start, ids


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` of every document, from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held_ids = [], 0
        for doc in _documents(batches):
            docs.append(doc)
            held_ids += len(doc[2])
            if held_ids >= 1 << 18:
                yield rows(docs)
                docs, held_ids = [], 0
        if docs:
            yield rows(docs)

    def rows(docs: list) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(ids) for _, _, ids in docs)], dtype=np.int32)
        values = np.concatenate([ids for _, _, ids in docs]).astype(np.int64)
        columns = [pa.array([x for x, _, _ in docs], pa.int64()), pa.array([start for _, start, _ in docs], pa.int64())]
        return pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "start", "ids"])

    return _laid_out(manifest).mapInArrow(run, "doc_id long, start long, ids array<long>")


def digests(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, as the shards are read."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for doc_id, start, ids in _documents(batches):
            found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
            if len(found) >= 4096:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=names)
                found = []
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    return _laid_out(manifest).mapInArrow(run, ", ".join(f"{name} long" for name in names))
