"""Numbers as sortable text keys and as little-endian bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of each integer type.
RANGES = {
    "int32": (-(1 << 31), (1 << 31) - 1),
    "uint32": (0, (1 << 32) - 1),
    "int64": (-(1 << 63), (1 << 63) - 1),
    "uint64": (0, (1 << 64) - 1),
}
#: Spark's type for each.
TYPES = {"int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)"}


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _checked(x: Column, kind: str, least: int | None = None) -> Column:
    low, high = RANGES[kind]
    low = low if least is None else least
    wide = x.cast("decimal(38,0)")
    bad = (wide < F.lit(str(low)).cast("decimal(38,0)")) | (wide > F.lit(str(high)).cast("decimal(38,0)"))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not in the range of a {kind} key: "), wide.cast("string")))).otherwise(wide)


def to_key(x: Column | str, kind: str = "int64") -> Column:
    """A number as text padded with zeros to ten digits, longer ones whole, so that text order is number
    order up to ten digits. Negative numbers are an error."""
    digits = _checked(_column(x), kind, least=0).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(10) - F.length(digits), F.lit(0))), digits)


def from_key(s: Column | str, kind: str = "int64") -> Column:
    """The integer that a string starts with, after white space; 0 if there is none or it is out of range."""
    number = F.regexp_extract(_column(s), r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
    low, high = RANGES[kind]
    wide = F.nullif(number, F.lit("")).try_cast("decimal(38,0)")
    inside = (wide >= F.lit(str(low)).cast("decimal(38,0)")) & (wide <= F.lit(str(high)).cast("decimal(38,0)"))
    return F.when(_column(s).isNotNull(), F.coalesce(F.when(inside, wide), F.lit(0).cast("decimal(38,0)")).cast(TYPES[kind]))


def _turned(digits: Column, size: int) -> Column:
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def encode(x: Column | str, kind: str) -> Column:
    """The little-endian bytes of a number, 4 or 8 of them."""
    size = 4 if kind.endswith("32") else 8
    wide = _checked(_column(x), kind)
    if kind == "uint64":  # hex() takes bigints, so the upper half of the range goes in as negative numbers
        two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
        wide = F.when(wide > F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"), wide - two64).otherwise(wide)
    digits = F.right(F.lpad(F.hex(wide.cast("bigint")), 16, "0"), F.lit(2 * size))
    return F.unhex(_turned(digits, size))


def decode(b: Column | str, kind: str) -> Column:
    """The number that little-endian bytes stand for; a wrong number of bytes is an error."""
    size = 4 if kind.endswith("32") else 8
    b = _column(b)
    wide = F.conv(_turned(F.hex(b), size), 16, 10).cast("decimal(38,0)")
    if kind.startswith("int"):
        bits = 8 * size
        wide = F.when(wide >= F.lit(str(1 << (bits - 1))).cast("decimal(38,0)"), wide - F.lit(str(1 << bits)).cast("decimal(38,0)")).otherwise(wide)
    bad = F.raise_error(F.concat(F.lit(f"a {kind} has {size} bytes, not "), F.octet_length(b).cast("string")))
    return F.when(b.isNotNull(), F.when(F.octet_length(b) != size, bad).otherwise(wide)).cast(TYPES[kind])
