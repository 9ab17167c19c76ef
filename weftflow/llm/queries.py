"""The queries of this subpackage, one for each operator, over whole tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. :data:`ORACLES` has DuckDB SQL for those that SQL
can express; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, decontaminate, exact_dedup, language, pii, quality, secret_ledger, simhash, span_oracles, token_store, url_filter
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    manifest = token_store.write(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.digests(manifest)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(bpe_replay.encode_and_decode(documents, ranks, public_tokenizers.PATTERN))


def bpe_digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def spelled(spans: str, *kinds: str) -> Column:
    """``kind:start:end`` of each span, comma-joined; of some kinds or of all."""
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(spans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The counts of the base kinds, the digest of their spans, and all spans."""

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = F.sha2(spelled("spans", *kinds).cast("binary"), 256).alias("base_sha256")
    return spans.select("doc_id", *counts, base, spelled("spans").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(pii.find(table(spark, sf_dir, "documents")), pii.BASE)


def dealt(id_col: str, parts: int) -> Column:
    """A document's part, by the crc32 of its id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model | None:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), dealt("doc_id", 5) != 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(dealt("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", predicted)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents, dealt("doc_id", 4) != 2)
    held_out = F.coalesce(dealt("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language.identify(documents, model).select("doc_id", held_out, "lang_pred", "score", "accepted")


#: The rules of the contract (fixed values): verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_ledger.scan(table(spark, sf_dir, "documents"), new_path(spark, "secret-ledger"))
    return found(scanned, secret_ledger.BASE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe_replay": op4_bpe_replay,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_language": op9_language,
    "op10_secret_ledger": op10_secret_ledger,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_pii": span_oracles.personal(),
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_secret_ledger": span_oracles.secrets(),
}
