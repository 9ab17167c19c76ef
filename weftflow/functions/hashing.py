"""String hashes as Column expressions: twelve functions, a name registry, and shard numbers.

Hashes run over the UTF-8 bytes of a string, read as signed numbers (a byte of 128 or more counts as itself
less 256), in unsigned 32-bit arithmetic. Values are bigints; :func:`md5_64` is a decimal(20,0). Null gives null.
Everything stays in the JVM: a fold over the array of bytes, with every step masked to 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Seeds and multipliers (fixed values).
JS_SEED = 1315423911
DJB_SEED = 5381
BKDR_FACTOR = 131
SDBM_FACTOR = 65599
DJB_FACTOR = 33
RS_FACTOR = 63689
RS_FACTOR_FACTOR = 378551
FNV_FACTOR = 0x811C9DC5
AP_SEED = 0xAAAAAAAA
HIGH_NIBBLE = 0xF0000000
#: Bytes of a key that is hashed with others at once.
LONG = 256


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _low(x: Column) -> Column:
    return x.bitwiseAND(_long(MASK))


def _up(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits)


def _down(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def _times(a: Column, b: Column | int) -> Column:
    """a * b in 32 bits; the halves of b keep every product within a bigint."""
    if isinstance(b, int):
        high, low = _long(b >> 16), _long(b & 0xFFFF)
    else:
        high, low = _down(b, 16), b.bitwiseAND(_long(0xFFFF))
    return _low(_low(a * high).bitwiseAND(_long(0xFFFF)) * _long(1 << 16) + a * low)


def signed_bytes(s: Column | str) -> Column:
    """The UTF-8 bytes of a string as an array of bigints from -128 to 127."""
    s = F.col(s) if isinstance(s, str) else s
    # one character for each byte, so that the array comes from one split
    characters = F.split(F.decode(F.encode(s, "UTF-8"), "ISO-8859-1"), "")
    codes = F.transform(characters, lambda c: F.ascii(c).cast("long"))
    codes = F.transform(codes, lambda b: F.when(b > 127, b - 256).otherwise(b))
    return F.when(s.isNotNull(), F.when(F.octet_length(s) == 0, F.array().cast("array<bigint>")).otherwise(codes))


def _fold(s: Column | str, seed: Column | int, step: Callable[[Column, Column], Column]) -> Column:
    start = _long(seed) if isinstance(seed, int) else seed.cast("long")
    return F.aggregate(signed_bytes(s), start, lambda h, c: _low(step(h, c)))


def js_hash(s: Column | str) -> Column:
    return _fold(s, JS_SEED, lambda h, c: h.bitwiseXOR(_up(h, 5) + c + _down(h, 2)))


def bkdr_hash(s: Column | str) -> Column:
    return _fold(s, 0, lambda h, c: h * BKDR_FACTOR + c)


def sdbm_hash(s: Column | str) -> Column:
    return _fold(s, 0, lambda h, c: h * SDBM_FACTOR + c)


def djb_hash(s: Column | str) -> Column:
    return _fold(s, DJB_SEED, lambda h, c: h * DJB_FACTOR + c)


def dek_hash(s: Column | str) -> Column:
    """Starts at the length in bytes."""
    s = F.col(s) if isinstance(s, str) else s
    return _fold(s, F.octet_length(s), lambda h, c: _up(h, 5).bitwiseXOR(_down(h, 27)).bitwiseXOR(c))


def bp_hash(s: Column | str) -> Column:
    return _fold(s, 0, lambda h, c: _up(h, 7).bitwiseXOR(c))


def fnv_hash(s: Column | str) -> Column:
    """Starts at 0, unlike the standard function of that name."""
    return _fold(s, 0, lambda h, c: _times(h, FNV_FACTOR).bitwiseXOR(c))


def _folded_nibble(h: Column, c: Column) -> Column:
    # the high nibble is folded into bits 4 to 7 and cleared
    total = _low(_up(h, 4) + c)
    high = total.bitwiseAND(_long(HIGH_NIBBLE))
    return total.bitwiseXOR(_down(high, 24)).bitwiseAND(_long(MASK ^ HIGH_NIBBLE))


def pjw_hash(s: Column | str) -> Column:
    return _fold(s, 0, _folded_nibble)


def elf_hash(s: Column | str) -> Column:
    """Clearing the high nibble when it is zero changes nothing, so this is :func:`pjw_hash`."""
    return _fold(s, 0, _folded_nibble)


def rs_hash(s: Column | str) -> Column:
    """The factor changes from byte to byte, so it rides along."""
    start = F.struct(_long(0).alias("h"), _long(RS_FACTOR).alias("a"))
    step = lambda x, c: F.struct(_low(_times(x["h"], x["a"]) + c).alias("h"), _times(x["a"], RS_FACTOR_FACTOR).alias("a"))
    return F.aggregate(signed_bytes(s), start, step, lambda x: x["h"])


def ap_hash(s: Column | str) -> Column:
    """Bytes at even and odd places are mixed in differently."""

    def step(x: Column, c: Column) -> Column:
        h = x["h"]
        even = _up(h, 7).bitwiseXOR(c * _down(h, 3))
        odd = F.bitwise_not(_up(h, 11) + c.bitwiseXOR(_down(h, 5)))
        mixed = h.bitwiseXOR(F.when(x["even"], even).otherwise(odd))
        return F.struct(_low(mixed).alias("h"), (~x["even"]).alias("even"))

    start = F.struct(_long(AP_SEED).alias("h"), F.lit(True).alias("even"))
    return F.aggregate(signed_bytes(s), start, step, lambda x: x["h"])


def md5_64(s: Column | str) -> Column:
    """The first eight bytes of the MD5 digest as a little-endian unsigned number."""
    digest = F.md5(F.col(s) if isinstance(s, str) else s)
    turned = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in reversed(range(8))))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


#: Hash functions by name.
HASHES: dict[str, Callable[[Column | str], Column]] = {
    "rs": rs_hash,
    "js": js_hash,
    "pjw": pjw_hash,
    "elf": elf_hash,
    "bkdr": bkdr_hash,
    "sdbm": sdbm_hash,
    "djb": djb_hash,
    "dek": dek_hash,
    "bp": bp_hash,
    "fnv": fnv_hash,
    "ap": ap_hash,
    "md5_64": md5_64,
}


def hash_function(name: str) -> Callable[[Column | str], Column]:
    """A hash by its exact name; unknown names are a KeyError."""
    return HASHES[name]


def shard_of(key: Column | str, shards: int, hash_name: str = "js") -> Column:
    """The shard of a key: its hash modulo the number of shards."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    return (hash_function(hash_name)(key) % shards).cast("int")


def js_hash_of(key: str | bytes) -> int:
    """:func:`js_hash` of one key in Python, for code that runs in Python workers anyway."""
    h = JS_SEED
    for byte in key.encode() if isinstance(key, str) else key:
        h ^= (h << 5) + (byte - 256 if byte > 127 else byte) + (h >> 2)
        h &= MASK
    return h


def js_hashes_of(keys: pa.Array) -> np.ndarray:
    """:func:`js_hash` of string or binary keys without nulls, all at once: one step for each byte of the longest
    of them. The few that are longer than ``LONG`` bytes are hashed alone."""
    if len(keys) == 0:
        return np.zeros(0, dtype=np.uint32)
    ends = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = keys.buffers()[2]
    signed = np.frombuffer(data, dtype=np.int8) if data else np.zeros(0, dtype=np.int8)
    sizes = np.diff(ends)
    order = np.argsort(-np.where(sizes > LONG, 0, sizes), kind="stable")
    starts, left = ends[:-1][order], np.where(sizes > LONG, 0, sizes)[order]
    h = np.full(len(keys), JS_SEED, dtype=np.uint32)
    for at in range(int(left[0])):
        n = int(np.searchsorted(-left, -at, side="left"))  # keys that have a byte here
        now = h[:n]
        now ^= (now << np.uint32(5)) + signed[starts[:n] + at].astype(np.int32).view(np.uint32) + (now >> np.uint32(2))
    out = np.empty_like(h)
    out[order] = h
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = js_hash_of(keys[k].as_py())
    return out
