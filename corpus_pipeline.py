"""A training corpus from ``documents``: filter, deduplicate, decontaminate and tokenise.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before kept and returns a
DataFrame; all but the last return the columns they were given. Between stages rows are written to the
shared folder and read again, so a lost executor repeats at most part of one stage.

1. ``quality``: documents that the quality classifier scores below its threshold go;
2. ``exact_dedup``: of equal texts the one with most characters stays, then the smallest id;
3. ``simhash``: of each class of near-duplicates the smallest id stays;
4. ``decontaminate``: documents that hold a benchmark item go;
5. ``bpe``: the ids of each remaining text, and digests of the ids and of what they decode to.

Stages 2 to 4 don't move the rows that stay: each lists the rows that go, and only rows that a Bloom filter
of the list doesn't clear are joined with it.

Nulls, empty texts, repeated rows and empty tables are handled by the operators, as their docstrings say. Ties: a
score equal to the threshold stays; of equal texts of one length the smallest id stays, and of rows that repeat
id and text one. Where texts that are no copies share an id, each is a document of its own. Rows with a null id
take part, after all others in order; one row for each text of a class of near-duplicates stays where all of its
ids are null. Stages read their input more than once, so it must be a table or a plan that gives the same rows again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftflow.llm import bpe_replay, decontaminate, exact_dedup, quality, simhash
from weftflow.llm.common import written
from weftflow.llm.queries import bpe_digests, dealt, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted as in ``op7_quality``, on labelled rows outside the held-out fifth."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), dealt("doc_id", 5) != 0)
    return quality.keep(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(bpe_replay.encode_and_decode(docs, ranks, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("quality", by_quality),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the fingerprints have no SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None
