"""Personal data by anchor expansion (operator 5).

One Aho-Corasick automaton finds anchors in a whole text: at-signs, plus signs, digits, ``://`` and cues such
as "IBAN" or "account". A deterministic parser for each kind expands an anchor to its boundaries and
validates what it finds. Positions are code points, ends exclusive.

Base kinds are found exactly as leftmost non-overlapping matches, a failed match being dropped without
another try:

* ``email``: local part, ``@``, at least two dot-separated labels;
* ``ip``: four dot-separated numbers of at most 255;
* ``card``: 13 to 19 digits, single blanks or hyphens between them, with a valid Luhn sum;
* ``phone``: a plus sign and 9 to 15 digits.

Anchors add two kinds, which never change base ones:

* ``account``, after a cue and at most three linking words: an IBAN, which ends where its country's length or,
  for other countries, the longest valid checksum says, and before no letter or digit; or else a number of 6 to
  20 digits: one run of digits, or if that has fewer than 6, groups with one kind of separator;
* ``address``: an http, https or ftp address that starts with a letter or digit, without closing punctuation.

Every parser takes time in proportion to the text: what it has looked at and refused isn't looked at again.

Edge cases: null and empty texts have no spans; repeated rows are repeated; other columns are left out (by
:func:`find`) or kept (by :func:`redact`) whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from ..operators.routing import spread
from .common import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address")
KINDS = (*BASE, *ADDED)
#: Words that announce an account or identity number (fixed values).
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")
SCHEMES = ("http", "https", "ftp")
SPANS = "array<struct<kind: string, start: int, end: int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words that may stand between a cue and its number, and lengths of IBANs by country (fixed values).
LINKS = ("number", "no", "nr", "num", "is", "was", "of", "my", "the", "es", "ist", "est", "lautet")
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
_AFTER_CUE = re.compile(rf"(?:[ ]?\b(?:{'|'.join(LINKS)})\b\.?){{0,3}}[ ]*[:#=]?[ ]*", re.IGNORECASE | re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9]{6,20}(?![0-9A-Za-z])|[0-9]{1,5}(?:(?:-[0-9]+)+|(?: [0-9]+)+)(?![0-9A-Za-z])")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
_CLOSING = ".,;:!?)]"


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *_DIGITS):
        found.add_word(anchor, ("d" if anchor in _DIGITS else anchor, len(anchor)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """Where the IBAN that starts here ends, or -1."""
    m = _IBAN.match(text, start)
    if not m:
        return -1
    ends = [k + 1 for k in range(start, m.end()) if text[k] != " "]  # after each letter or digit
    size = IBAN_LENGTHS.get(text[start : start + 2])
    for k in [size] if size else range(len(ends), 14, -1):
        if k <= len(ends) and not text[ends[k - 1] : ends[k - 1] + 1].isalnum() and iban(text[start : ends[k - 1]]):
            return ends[k - 1]
    return -1


def number_end(text: str, start: int) -> int:
    """Where the account number that starts here ends, or -1: groups are taken up to 20 digits."""
    m = _NUMBER.match(text, start, start + 64)
    if not m:
        return -1
    groups = re.split("[ -]", m[0])
    size, end = 0, start - 1
    for group in groups:
        if size + len(group) > 20:
            break
        size, end = size + len(group), end + 1 + len(group)
    return end if size >= 6 else -1


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    to = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended, kept or dropped
    run_end = run_closed = 0  # of the characters of addresses that were last looked at
    for last, (anchor, size) in automaton.iter(text):
        at = last + 1 - size
        if anchor == "d":
            if at >= to["card"] and (m := _CARD.match(text, at)):
                to["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= to["ip"] and (at == 0 or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                to["ip"] = m.end()
                if all(len(part := x.lstrip("0")) <= 3 and int(part or "0") <= 255 for x in m[0].split(".")):
                    found["ip"].append(m.span())
        elif anchor == "@":
            start = at
            while start > to["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                to["email"] = m.end()
                found["email"].append((start, m.end()))
        elif anchor == "+":
            if at >= to["phone"] and (m := _PHONE.match(text, at)):
                to["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "://":
            start = at
            while start and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start >= to["address"] and text[start:at].lower() in SCHEMES:
                if last + 1 >= run_end:
                    m = _ADDRESS.match(text, last + 1)
                    run_end = m.end() if m else last + 1
                    run_closed = last + 1 + len(m[0].rstrip(_CLOSING)) if m else last + 1
                if run_closed > last + 1 and text[last + 1].isalnum():
                    to["address"] = run_closed
                    found["address"].append((start, run_closed))
        elif at >= to["account"] and (at == 0 or not text[at - 1].isalnum()):
            start = _AFTER_CUE.match(text, last + 1).end()
            end = max(iban_end(text, start), number_end(text, start))
            if end > 0:
                to["account"] = end
                found["account"].append((start, end))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans array<struct<kind, start, end>>`` of each whole text, by kind, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(text, automaton)] for text in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(rows, _FOUND)], names=["doc_id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(read).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in angle brackets; null texts stay null.

    Where spans of several kinds overlap, they are replaced together, by the kind of the one that starts
    first (the longest, at one start).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()

        def clean(text: str | None) -> str | None:
            out, at = [], 0
            for kind, start, end in sorted(spans(text or "", automaton), key=lambda s: (s[1], -s[2])):
                if start >= at:
                    out += [text[at:start], f"<{kind}>"]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                texts = pa.array([clean(text) for text in part.column(k).to_pylist()], batch.schema.field(k).type)
                yield part.set_column(k, batch.schema.field(k), texts)

    return spread(df).mapInArrow(run, df.schema)
