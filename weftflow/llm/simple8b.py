"""Simple-8b: unsigned integers packed into 64-bit words, in numpy.

The top four bits of a word are its selector, which says how many integers of how many bits the other 60
hold. An integer of more than 60 bits is an escape: its word says so, and its value stands in a list beside
the words, so that all words of a block can be decoded at once.
"""

from __future__ import annotations

import numpy as np

#: (integers, bits each) by selector; selector 0 marks an escape (fixed values of the format).
SELECTORS = ((1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (240, 0))
_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int32)
_BY_BITS = sorted((bits, n, k) for k, (n, bits) in enumerate(SELECTORS) if k)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``values`` (unsigned), each with as many integers as fit, and the escaped values."""
    values = np.ascontiguousarray(values, dtype=None if values.dtype == np.uint32 else np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    if values.dtype == np.uint64 and values.max() < 1 << 32:
        values = values.astype(np.uint32)
    chosen = np.zeros(n, dtype=np.int8)  # the selector for a word that starts here; 0 stays for escapes
    for bits, count, selector in sorted(_BY_BITS, key=lambda x: x[1]):  # the largest count that fits comes last
        if count > n:
            continue
        if bits >= 32 and values.dtype == np.uint32:
            chosen[: n - count + 1] = selector
            continue
        narrow = values < values.dtype.type(1 << bits)
        few = int(np.count_nonzero(narrow))
        if few < count:
            continue
        # [first, end) of the runs of integers that are narrow enough, from whichever kind is rarer
        if 2 * few < n:
            at = np.flatnonzero(narrow)
            gap = np.flatnonzero(np.diff(at) != 1)
            first, end = at[np.append(0, gap + 1)], at[np.append(gap, few - 1)] + 1
        else:
            wide = np.flatnonzero(~narrow)
            first, end = np.append(-1, wide) + 1, np.append(wide, n)
        long = end - first >= count
        if long.any():
            turns = np.zeros(n + 1, dtype=np.int8)
            turns[first[long]] = 1
            turns[end[long] - count + 1] = -1
            np.copyto(chosen, selector, where=np.cumsum(turns[:n], dtype=np.int8).view(bool))
    first = _chain(_COUNTS[chosen])
    selectors = chosen[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        count, bits = SELECTORS[selector]
        if not bits:
            continue
        which = np.flatnonzero(selectors == selector)
        at = first[which]
        word = values[at].astype(np.uint64)
        for k in range(1, count):
            word |= values[at + k].astype(np.uint64) << np.uint64(k * bits)
        words[which] |= word
    return words, values[first[selectors == 0]].astype(np.uint64)


def _chain(steps: np.ndarray, levels: int = 5) -> np.ndarray:
    """The positions met from 0 on when every position says how far the next one is.

    Jumps of 2, 4, 8, ... steps are made for all positions at once; only each 32nd position is walked to, and
    those between are filled in from the longest jump down.
    """
    n = len(steps)
    jumps = [np.append(np.minimum(np.arange(n) + steps, n), n).astype(np.int32)]
    for _ in range(levels):
        jumps.append(jumps[-1][jumps[-1]])
    walked, at = [], 0
    while at < n:
        walked.append(at)
        at = int(jumps[levels][at])
    met = np.array(walked, dtype=np.int32)
    for jump in reversed(jumps[:levels]):
        met = np.stack([met, jump[met]], axis=1).ravel()
    return met[met < n]


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values that :func:`pack` was given."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    ends = np.cumsum(counts, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        count, bits = SELECTORS[selector]
        which = np.flatnonzero(selectors == selector)
        first = ends[which] - count
        if selector == 0:
            out[first] = escaped
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[:, None] + np.arange(count)] = (words[which][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out
