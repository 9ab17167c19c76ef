"""Secret scans over an incremental blob ledger (operator 10).

Every version of every document is a blob, addressed by the SHA-256 of its text. The ledger is a table of
(blob, rule version, spans): what has been scanned, and what was found. A scan reads only blobs that the
ledger doesn't have under the current rule version, each once however many documents share it, appends what
it finds, and joins the findings of the ledger back to all documents. A new rule version scans all again;
new documents of known text cost a hash.

Only hashes are exchanged. The rows to scan are picked by a list of those that need no scan, or of those that
do, whichever is shorter: rows that a Bloom filter of the list tells apart stay where they are.

Base kinds are leftmost non-overlapping matches, a failed match being dropped without another try:
``assign`` (a credential's name, then a value of 6 or more characters), ``access`` (``AKIA`` and capitals or
digits, 20 or more in all) and ``hex`` (24 or more lower-case hex digits). The rules add ``private_key``,
``jwt`` (after a character that can't be in one) and ``vendor`` tokens; these never change base ones. Positions
are code points, ends exclusive. Every rule takes time in proportion to the text.

Edge cases: a null text is the empty blob; repeated rows share a blob, are scanned once and repeated in the
result; null document ids are ids like others; other columns are left out, so their names can't clash; an
empty table scans nothing and gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import spread
from .common import Tables, joined, mark_of, only, slices, without

BASE = ("assign", "access", "hex")
ADDED = ("private_key", "jwt", "vendor")
KINDS = (*BASE, *ADDED)
#: Kind, pattern, the group whose length counts and its least length (fixed values).
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("vendor", r"(?:ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]+", 0, 24),
)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_COMPILED = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in RULES]
LEDGER = "blob string, rule_version string, spans array<struct<kind: string, start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by start, then kind as listed."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scanned(blobs: DataFrame) -> DataFrame:
    """``blob, rule_version, spans`` for each row of ``blobs(blob, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(text)] for text in part.column(1).to_pylist()]
                version = pa.array([RULE_VERSION] * len(rows))
                yield pa.record_batch([part.column(0), version, pa.array(rows, _SPANS)], names=["blob", "rule_version", "spans"])

    return blobs.mapInArrow(run, LEDGER)


def _ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(df: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, spans`` for every row; blobs that the ledger at ``ledger`` lacks are scanned first.

    The ledger is appended to in one write, which Spark commits whole or not at all; a scan that fails
    before leaves it as it was, and blobs written twice by rival scans count once.
    """
    spark = df.sparkSession
    tables, own = Tables(spark), Tables(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = df.select(F.col(id_col).alias("doc_id"), mark_of(text).alias("mark"), F.sha2(text.cast("binary"), 256).alias("blob"))
    paths = tables.write(paths, "blob-paths", read_by_result=True)
    seen = _ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob").distinct().withColumn("seen", F.lit(True))
    one = paths.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("of"), F.count("*").alias("rows"), F.first("mark").alias("mark"))
    blobs = own.write(one.join(seen, "blob", "left").select("blob", F.col("of.doc_id").alias("of_id"), "mark", "rows", F.coalesce("seen", F.lit(False)).alias("seen")), "blobs")
    fresh = _unseen(spread(df.select(id_col, text_col)), paths, blobs, own, id_col, text_col)
    if fresh is not None:
        fresh = fresh.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        scanned(fresh.select(F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")).write.mode("append").parquet(ledger)
    found = _ledger(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.first("spans").alias("spans")).join(blobs.select("blob", "rows"), "blob")
    found = tables.write(found, "findings", read_by_result=True)
    own.done()
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return joined(paths, found, ["blob"], "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def _unseen(df: DataFrame, paths: DataFrame, blobs: DataFrame, own: Tables, id_col: str, text_col: str) -> DataFrame | None:
    """One row of ``df`` for each blob that isn't seen, if there are any."""
    counts = blobs.agg(F.sum("rows").alias("rows"), F.count_if(~F.col("seen")).alias("blobs")).first()
    if not counts.blobs:
        return None
    if 2 * counts.blobs <= counts.rows:
        return only(df, blobs.where("not seen").select(F.col("of_id").alias("doc_id"), "mark"), own, id_col, text_col)
    known = own.write(blobs.where("seen or rows > 1").drop("mark"), "blobs-known")
    copies = joined(paths, known, ["blob"])
    stays = F.bool_or(~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("of_id")))
    listed = copies.groupBy("doc_id", "mark").agg(stays.alias("stays"), F.count("*").alias("rows"))
    return without(df, listed.where("not stays or rows > 1"), own, id_col, text_col)
