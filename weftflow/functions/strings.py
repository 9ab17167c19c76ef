"""Splitting, joining and formatting strings, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_using(s: Column | str, delimiters: str) -> Column:
    """Tokens between any of the characters of ``delimiters``; empty tokens are dropped.

    Without delimiters the whole string is one token.
    """
    s = F.col(s) if isinstance(s, str) else s
    if not delimiters:
        return F.array_remove(F.array(s), "")
    pattern = "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiters) + "]"
    return F.array_remove(F.split(s, pattern), "")


def split_to_set(s: Column | str, delimiters: str) -> Column:
    """:func:`split_using` without repeats, in byte order."""
    return F.array_sort(F.array_distinct(split_using(s, delimiters)))


def join_strings(parts: Column | str, delimiter: str = " ") -> Column:
    """The elements of an array with a delimiter between them; nothing is escaped, nulls are left out."""
    return F.array_join(parts, delimiter)


#: A conversion of C's printf: flags, width, precision, length and kind.
_CONVERSION = re.compile(r"%([-+ #0]*)([0-9]*)(\.[0-9]+)?(hh|h|ll|l|q|j|z|t|L)?(.?)", re.DOTALL)
_WIDE = ("l", "ll", "q", "j", "z", "t")


def string_printf(pattern: str, *arguments: Column | str) -> Column:
    """C formatting: ``%d %i %u %x %X %o %c %s %e %E %f %g %G %a %A %%``, with flags, width, precision and length.

    Lengths matter for ``%u``, which takes negative numbers as unsigned ones of 32 bits or, with ``l`` and
    longer, 64. ``%g`` keeps trailing zeros. ``*``, ``%n`` and ``%p`` are a ValueError, as are missing arguments.
    """
    out, taken, at = "", [], 0
    for m in _CONVERSION.finditer(pattern):
        flags, width, precision, length, kind = m.groups()
        out += pattern[at : m.start()]
        at = m.end()
        if kind == "%":
            out += "%%"
            continue
        if kind not in tuple("diuxXocseEfFgGaA"):
            raise ValueError(f"cannot format {m[0]!r}")
        if len(taken) == len(arguments):
            raise ValueError(f"too few arguments for {pattern!r}")
        value = arguments[len(taken)]
        value = F.col(value) if isinstance(value, str) else value
        if kind == "u":
            two = F.lit(str(1 << (64 if length in _WIDE else 32))).cast("decimal(38,0)")
            wide = value.cast("decimal(38,0)")
            value = F.when(wide < 0, wide + two).otherwise(wide).cast("string")
            if "0" in flags and width and "-" not in flags:
                value = F.lpad(value, F.greatest(F.lit(int(width)), F.length(value)), "0")
            out += "%" + ("-" if "-" in flags else "") + width + "s"
        else:
            kind = {"i": "d", "F": "f"}.get(kind, kind)
            out += f"%{''.join(dict.fromkeys(flags.replace('0', '') if '-' in flags else flags))}{width}{precision or ''}{kind}"
        taken.append(value)
    if len(taken) < len(arguments):
        raise ValueError(f"too many arguments for {pattern!r}")
    return F.format_string(out + pattern[at:], *taken) if taken else F.lit((out + pattern[at:]).replace("%%", "%"))


def string_append(to: Column | str, pattern: str, *arguments: Column | str) -> Column:
    """``to`` with a formatted string after it."""
    return F.concat(F.col(to) if isinstance(to, str) else to, string_printf(pattern, *arguments))
