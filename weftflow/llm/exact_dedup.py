"""Exact duplicates by a tree-merge of sorted digest runs (operator 3), in DataFrame operations only.

Every scan partition is a run: it reduces its rows to one per digest, sorted, before anything moves. Runs are
numbered, and partitions then exchange them in binomial rounds: in round r the ``fan`` runs whose numbers
differ in digit r alone (written in base ``fan``) merge, each partition taking from all of them the digests
with its own digit r, sorting and keeping the smallest identifier. After the last round a digest's row is in the
one partition that its digits name. The number of rounds is the logarithm of the number of partitions, and
a digest that a third of all rows share shrinks by ``fan`` a round; no task ever sees its rows.

Digests are verified at every level: a run's key is the SHA-256 of the normalised text together with an
independent 64-bit hash and the normalised length, so rows merge only where all three agree.

Normalised text: the text without the characters 0x20 and 0x09 to 0x0D; null counts as empty. Of equal
texts the row with the most code points stays, then the smallest document id (null ids last).

Edge cases: of rows that agree in document id and text too, one stays; empty texts are equal to each other;
other columns ride along untouched under their own names, whatever they are called; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, joined, mark_of, without

#: The most runs that meet in a round.
FAN = 32
KEY = ["digest", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``chars``, ``mark``, the verified digest and a ``tag`` of its own for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), mark_of(text).alias("mark"), normalised(text).alias("norm")).select(
        "doc_id",
        "chars",
        "mark",
        # said never to be null, lest joins make it twice to look
        F.coalesce(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), F.lit(bytearray())).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("size"),
        F.monotonically_increasing_id().alias("tag"),
    )


def merged(digests: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per distinct text, with the ``best`` row's order and the number of ``rows``, through binomial rounds.

    ``runs`` is how many partitions exchange, those of a shuffle by default.
    """
    runs = runs or int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(runs, FAN) - 1e-9))
    fan = next(f for f in range(1, FAN + 1) if f**rounds >= runs)
    slots = fan**rounds
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    part = digests.select(*KEY, best.alias("best"), F.lit(1).cast("long").alias("rows"), F.pmod(F.spark_partition_id(), F.lit(slots)).alias("slot"))
    for digit in range(1, rounds + 1):
        width = fan**digit
        # the digits done are the digest's own, the others still those of the run
        slot = F.expr(f"cast(slot div {width} * {width} + pmod(check, {width}) as int)")
        part = part.withColumn("slot", slot)
        if digit > 1:  # the first exchange is that of the aggregation, so that runs are reduced before it
            part = part.repartitionById(slots, F.col("slot"))
        part = part.groupBy("slot", *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return part.drop("slot")


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    tables = Tables(df.sparkSession)
    digests = tables.write(digest(df, id_col, text_col), "digests", read_by_result=True)
    best = tables.write(merged(digests), "digest-runs", read_by_result=True)
    return joined(digests.drop("mark", "chars"), best.withColumn("group_size", F.col("rows")), KEY).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; only those of repeated texts are looked at again."""
    tables = Tables(df.sparkSession)
    digests = tables.write(digest(df, id_col, text_col), "digests")
    best = tables.write(merged(digests).where("rows > 1"), "digest-runs")
    copies = joined(digests, best, KEY).select("doc_id", "mark", (F.col("tag") == F.col("best.tag")).alias("stays"))
    listed = copies.groupBy("doc_id", "mark").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    rows = without(df, listed, tables, id_col, text_col)
    tables.done()
    return rows


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
