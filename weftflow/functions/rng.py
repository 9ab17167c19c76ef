"""Random numbers as Column expressions: reproducible for a seed, evenly distributed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rand_double(seed: int | None = None) -> Column:
    """In [0, 1); a negative seed, or none, means a fresh one."""
    return F.rand() if seed is None or seed < 0 else F.rand(seed)


def rand_int(bound: int, seed: int | None = None) -> Column:
    """A whole number in [0, bound)."""
    if bound < 1:
        raise ValueError("the bound must be positive")
    return F.floor(rand_double(seed) * bound).cast("int")


def tick_count(at: Column | None = None) -> Column:
    """Milliseconds since midnight (UTC) of a timestamp, now by default."""
    return F.pmod(F.unix_millis(F.current_timestamp() if at is None else at), F.lit(86_400_000)).cast("int")
