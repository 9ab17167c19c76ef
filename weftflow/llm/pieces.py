"""Cutting text before blanks where the public pre-tokenisation pattern cuts as well.

A blank between two visible characters always starts a new match of the pattern, so pieces between such
blanks can be tokenised apart and their results joined. A blank that follows other white space may lie
inside a match; texts that have one are cut with a slower exact rule.

:func:`packed` numbers the distinct pieces of many texts in Arrow, so that Python handles each distinct
piece of a slice once, and each distinct word once while :class:`PieceCoder` remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import UnitCache

#: White space besides the blank (fixed values: Unicode White_Space, and the separators 0x1C to 0x1F).
OTHER_ASCII = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_WIDE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SAFE_CUT = re.compile(f"(?= [^ {OTHER_ASCII}{OTHER_WIDE}])")
#: Bytes of a text that is taken in parts.
LONG = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[np.frombuffer((" " + OTHER_ASCII).encode(), dtype=np.uint8)] = True
#: The last two bytes of the other white space, as a number.
_WIDE = np.array(sorted({int.from_bytes(c.encode()[-2:], "big") for c in OTHER_WIDE}), dtype=np.uint16)


def doubtful(text: np.ndarray) -> bool:
    """Whether some blank of the UTF-8 bytes may come after other white space."""
    at = np.flatnonzero(text[1:] == 32)
    before = text[at]
    if _SPACE[before].any():
        return True
    wide = at[before >= 128]
    return bool(np.isin(text[wide - 1].astype(np.uint16) << 8 | text[wide], _WIDE).any())


def cut(text: str) -> list[str]:
    """Pieces of ``text``; joined they give ``text``, and no match of the pattern spans two of them."""
    return [piece for piece in _SAFE_CUT.split(text) if piece]


class PieceCoder:
    """Packed values of pieces: each is split into words, and each new word is coded once.

    Pieces after a blank are remembered in two Arrow arrays, which take little memory and are looked up for a
    whole slice at once; words in a bounded memo. Results never depend on what is remembered.
    """

    #: Length in bytes of the longest piece that is remembered.
    LONGEST = 64

    def __init__(self, split: Callable[[str], list[str]], code: Callable[[list[str]], list[bytes]], pieces: int = 300_000, words: int = 100_000):
        self.split, self.words, self.most = split, UnitCache(code, most=words), pieces
        self.known, self.values = pa.array([], pa.string()), pa.array([], pa.binary())

    def __call__(self, pieces: list[str]) -> list[bytes]:
        split = self.split
        # a blank or letter and then letters only is one word
        words = [[x] if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else split(x) for x in pieces]
        get = self.words.ready(words).__getitem__
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in words]

    def after_blank(self, pieces: pa.StringArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """Values, and for each of the distinct ``pieces`` the place of its own, with a blank before it."""
        found = pc.index_in(pieces, value_set=self.known)
        at, new = found.fill_null(0).to_numpy().copy(), np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        values = self.values
        if len(new):
            fresh = pieces.take(pa.array(new))
            coded = pa.array(self([" " + x for x in fresh.to_numpy(zero_copy_only=False).tolist()]), pa.binary())
            at[new] = len(values) + np.arange(len(new))
            values = pa.concat_arrays([values, coded])
            short = pc.less_equal(pc.binary_length(fresh), self.LONGEST)
            if len(self.known) + len(new) > self.most:  # begin again with what this slice has
                again = pieces.filter(found.is_valid())
                self.known = pa.concat_arrays([again, fresh.filter(short)])
                self.values = pa.concat_arrays([self.values.take(found.drop_null()), coded.filter(short)])
            else:
                self.known = pa.concat_arrays([self.known, fresh.filter(short)])
                self.values = pa.concat_arrays([self.values, coded.filter(short)])
        return at, values


_HELD: dict[object, Any] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """The worker's coder for ``key``. A worker serves many stages; it holds one coder at a time."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forget the worker's coder; stages that need none call this, so that its memory is free for them."""
    _HELD.clear()


def packed(texts: pa.Array, coder: PieceCoder) -> pa.BinaryArray:
    """The joined values of the pieces of each text; ``texts`` are strings without nulls.

    A text of more than ``LONG`` bytes is taken in parts that end where the pattern cuts as well.
    """
    n = len(texts)
    if n == 0:
        return pa.array([], pa.binary())
    size = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
    if size[-1] > size[0]:
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        if n == 1 and size[1] - size[0] > LONG:
            return pa.array([b"".join(_parts_packed(texts[0].as_py(), coder))], pa.binary())
        if doubtful(data[size[0] : size[-1]]):
            odd = [doubtful(data[a:b]) for a, b in zip(size.tolist(), size[1:].tolist())]
            if any(odd):
                return _apart(texts, odd, coder)
    return _fast(texts, coder)


def _parts_packed(text: str, coder: PieceCoder) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        found = _SAFE_CUT.search(text, at + LONG // 2)
        to = found.start() if found else len(text)
        part = pa.array([text[at:to]], pa.string())
        strange = doubtful(np.frombuffer(part.buffers()[2], dtype=np.uint8))
        yield from (_apart(part, [True], coder) if strange else _fast(part, coder)).to_pylist()
        at = to


def _apart(texts: pa.Array, odd: list[bool], coder: PieceCoder) -> pa.BinaryArray:
    plain = iter(_fast(texts.filter(pa.array([not x for x in odd])), coder).to_pylist())
    docs = [cut(text) for text in texts.filter(pa.array(odd)).to_pylist()]
    values = iter(coder([piece for pieces in docs for piece in pieces]))
    strange = iter([b"".join([next(values) for _ in pieces]) for pieces in docs])
    return pa.array([next(strange) if x else next(plain) for x in odd], pa.binary())


def _fast(texts: pa.Array, coder: PieceCoder) -> pa.BinaryArray:
    """Every blank is a cut: split, number the distinct pieces and pick their values, all in Arrow."""
    if len(texts) == 0:
        return pa.array([], pa.binary())
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    at = coded.indices.to_numpy()
    places, values = coder.after_blank(coded.dictionary)
    first = offsets[:-1]  # the first piece of a text has no blank before it
    heads = coded.dictionary.take(pa.array(at[first])).to_pylist()
    own = iter(coder([head for head in heads if head]))
    start = len(values)
    values = pa.concat_arrays([values, pa.array([next(own) if head else b"" for head in heads], pa.binary())])
    at = places[at]
    at[first] = start + np.arange(len(first))
    picked = values.take(pa.array(at))
    ends = np.frombuffer(picked.buffers()[1], dtype=np.int32)[offsets]
    return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), picked.buffers()[2]])
