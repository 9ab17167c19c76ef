"""Byte-level BPE by corpus-level merge replay (operator 4).

The distinct words of a slice of the corpus lie end to end in one linked list of tokens. An inverted index
maps each mergeable pair to the positions where it stands, in all words at once. Pairs are applied in rank
order, lowest first; a merge touches only its two neighbours, whose new pairs enter the index. A word that
gains a pair of lower rank than the one being applied has its remaining positions put back, so that within
each word merges happen exactly in the order of the usual one-word algorithm.

The corpus is taken a slice of some MB at a time, so that the index stays in a worker's memory: distinct words
are replayed once per worker while a bounded memo holds them. Documents are whole; long ones are taken in parts
that end where the pattern cuts as well, so only a single word of many MB takes memory in proportion (some 50
bytes a byte). Nothing is shuffled.

Edge cases: a null or empty text has no ids and decodes to empty bytes; repeated rows give repeated rows;
extra columns are left out, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from .common import list_array, slices
from .pieces import PieceCoder, held, packed, release


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Ranks of token pairs in an open-addressed numpy table, looked up for whole arrays at once."""

    def __init__(self, pairs: dict[int, int]):
        keys, ranks = (np.fromiter(x, dtype=np.int64, count=len(pairs)) for x in (pairs.keys(), pairs.values()))
        self.mask = (1 << max(4, len(pairs) * 4 - 1).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.ranks = np.full(self.mask + 1, -1, dtype=np.int64)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free[first]], ranks[free[first]]
            rest = np.setdiff1d(rest, free[first], assume_unique=True)
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair ``left << 32 | right``, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.ranks[slot[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out


class MergeReplay:
    """Encodes batches of words with the ranks of one vocabulary."""

    #: From so many positions on, a pair is applied to all of them with array operations.
    MANY = 24

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 31:
            raise ValueError("ranks must fit in 31 bits")
        self.ranks = ranks
        #: rank of the pair (a, b), by a << 32 | b
        self.pairs = {
            ranks[left] << 32 | ranks[right]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := token[:k]) in ranks and (right := token[k:]) in ranks
        }
        self.pair_ranks = PairTable(self.pairs)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("every single byte needs a rank")
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as packed little-endian 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:  # a word that is a token is that token, however merges would go
                out[k] = whole.to_bytes(4, "little")
            elif word:
                rest.append(k)
            else:
                out[k] = b""
        if rest:
            for k, ids in zip(rest, self._replay([words[k] for k in rest])):
                out[k] = ids
        return out

    def _replay(self, words: list[bytes]) -> Iterator[bytes]:
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), out=starts[1:])
        size = len(data)
        pairs = np.full(size, -1, dtype=np.int64)
        pairs[:-1] = self.byte_pairs[data[:-1], data[1:]]
        pairs[starts[1:] - 1] = -1  # no pair reaches over the end of a word
        tokens = self.byte_ids[data]
        afters = np.arange(1, size + 1)
        afters[starts[1:] - 1] = -1
        befores = np.arange(-1, size - 1)
        befores[starts[:-1]] = -1

        there = np.flatnonzero(pairs >= 0)
        order = there[np.argsort(pairs[there], kind="stable")]
        found, first = np.unique(pairs[order], return_index=True)
        index = dict(zip(found.tolist(), map(np.ndarray.tolist, np.split(order, first[1:]))))
        heap = found.tolist()  # sorted, hence a heap
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) >= self.MANY:
                at = np.array(places, dtype=np.int64)
                at = np.sort(at[pairs[at] == rank])
                at = at[np.diff(at, prepend=-1) > 0]
                if len(at) == 0 or self._apply_all(rank, at, tokens, pairs, afters, befores, index, heap):
                    continue
                places = at.tolist()
            else:
                places.sort()
            self._apply(rank, places, starts, tokens, pairs, afters, befores, index, heap)
        kept = tokens >= 0
        cuts = (np.concatenate([[0], np.cumsum(kept)])[starts] * 4).tolist()
        packed = tokens[kept].astype("<u4").tobytes()
        return (packed[a:b] for a, b in zip(cuts, cuts[1:]))

    def _apply_all(self, rank, at, tokens, pairs, afters, befores, index, heap) -> bool:
        """Merge at all positions at once; False, with nothing changed, where their order could matter."""
        gone = afters[at]
        if (gone[:-1] == at[1:]).any():  # overlapping occurrences, as in a run of one letter
            return False
        right, left = afters[gone], befores[at]
        touching = np.zeros(len(at), dtype=bool)  # the left neighbour is merged as well
        touching[1:] = (left[1:] == gone[:-1]) & (left[1:] >= 0)
        left[1:] = np.where(touching[1:], at[:-1], left[1:])
        to_right = np.where(right >= 0, self.pair_ranks(rank << 32 | tokens[right]), -1)
        to_left = np.where(left >= 0, self.pair_ranks(np.where(touching, rank, tokens[left]) << 32 | rank), -1)
        if ((to_right >= 0) & (to_right < rank)).any() or ((to_left >= 0) & (to_left < rank)).any():
            return False
        tokens[at], tokens[gone], pairs[gone], afters[at] = rank, -1, -1, right
        befores[right[right >= 0]] = at[right >= 0]
        pairs[at] = to_right
        pairs[left[left >= 0]] = to_left[left >= 0]
        for new, where in ((to_right, at), (to_left, left)):
            real = new >= 0
            for other, place in zip(new[real].tolist(), where[real].tolist()):
                if other in index:
                    index[other].append(place)
                else:
                    index[other] = [place]
                    heapq.heappush(heap, other)
        return True

    def _apply(self, rank, places, starts, tokens, pairs, afters, befores, index, heap) -> None:
        """Merge at one position after the other, from left to right."""
        token, pair, after, before = (memoryview(x) for x in (tokens, pairs, afters, befores))
        known = self.pairs.get
        held: list[int] = []
        held_to = -1
        for at in places:
            if pair[at] != rank:
                continue
            if at < held_to:
                held.append(at)
                continue
            gone = after[at]
            token[at] = rank
            token[gone] = pair[gone] = -1
            after[at] = right = after[gone]
            lowered = False
            new = -1
            if right >= 0:
                before[right] = at
                new = known(rank << 32 | token[right], -1)
                if new >= 0:
                    lowered = new < rank
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(heap, new)
            pair[at] = new
            left = before[at]
            if left >= 0:
                pair[left] = new = known(token[left] << 32 | rank, -1)
                if new >= 0:
                    lowered = lowered or new < rank
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(heap, new)
            if lowered:
                held_to = int(starts[np.searchsorted(starts, at, side="right")])
        if held:
            index[rank] = held + index.get(rank, [])
            heapq.heappush(heap, rank)


_TABLES: dict[str, pa.BinaryArray] = {}
#: Documents that are decoded at once, and bytes of text that are encoded at once.
ROWS = 512
SLICE = 1 << 20


def _encoder(ranks_path: str, pattern: str) -> PieceCoder:
    """The worker's coder for a vocabulary."""

    def make() -> PieceCoder:
        replay = MergeReplay(read_ranks(ranks_path))
        return PieceCoder(regex.compile(pattern).findall, lambda words: replay.encode(list(map(str.encode, words))))

    return held(("bpe", ranks_path, pattern), make)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``ids array<int>``: the tokens of each whole text, one row per row of ``df``.

    ``pattern`` must put a blank between visible characters at the start of a match, as the public ones do.
    A null text counts as empty.
    """
    return _coded(df, ranks_path, pattern, id_col, text_col, False)


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and then :func:`decode`, in one pass through one Python worker."""
    return _coded(df, ranks_path, pattern, id_col, text_col, True)


def _coded(df: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = list_array(packed(part.column(1), encoder), "<u4", pa.int32())
                for at in range(0, len(ids), ROWS):
                    columns = [part.column(0).slice(at, ROWS), ids.slice(at, ROWS)]
                    yield pa.record_batch(columns + [_texts(columns[1], ranks_path)] * back, names=["doc_id", "ids", "decoded"][: 2 + back])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(read).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * back)


def _texts(ids: pa.ListArray, ranks_path: str) -> pa.BinaryArray:
    """The bytes that each list of ids stands for."""
    if ranks_path not in _TABLES:
        ranks = read_ranks(ranks_path)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[ranks_path] = pa.array(table, pa.binary())
    tokens = _TABLES[ranks_path].take(ids.flatten())
    if tokens.null_count:
        raise ValueError("an id isn't in the vocabulary")
    offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
    ends = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[offsets - offsets[0]]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), tokens.buffers()[2]])


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns ``doc_id``, ``ids`` and ``decoded binary``: the bytes that the ids stand for.

    Null ids count as none. An id that isn't in the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.record_batch([part.column(0), part.column(1), _texts(part.column(1), ranks_path)], names=["doc_id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
