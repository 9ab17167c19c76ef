"""The pipeline's stages, each on what the one before kept."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F
from test_duplicates import brute_classes, brute_fingerprint
from test_text_scans import brute_leaks

import corpus_pipeline
from weftflow.llm import bpe_replay, quality
from weftflow.llm.queries import quality_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and those that come out of the last."""
    frames = [documents(spark)]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, frames[-1], SMALL).write.mode("overwrite").parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "decontaminate", "bpe"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 50


def test_quality_stage(spark, stages):
    scores = {r.doc_id: r.score for r in quality.score(stages[0], quality_model(spark, SMALL)).collect()}
    assert set(texts(stages[1])) == {i for i, s in scores.items() if s >= 0.3}


def test_exact_stage(stages):
    best = {}
    for i, t in texts(stages[1]).items():
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
    assert set(texts(stages[2])) == {i for _, i in best.values()}


def test_near_stage(stages):
    rows = sorted(texts(stages[2]).items())
    labels = brute_classes([brute_fingerprint(t) for _, t in rows])
    assert set(texts(stages[3])) == {i for k, (i, _) in enumerate(rows) if labels[k] == k}


def test_benchmark_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = texts(stages[3])
    assert set(texts(stages[4])) == set(before) - {x[0] for x in brute_leaks(list(before.items()), items)}


def test_tokens_stage(stages):
    ranks = bpe_replay.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(stages[4])
    for r in stages[5].collect():
        ids = encoding.encode_ordinary(before[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
    assert stages[5].count() == len(before)


def test_run_is_the_stages(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == {r.doc_id for r in stages[5].select("doc_id").collect()}


def test_odd_and_empty_inputs(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "text " * 30000, None, "s", 5)],
        documents(spark).schema,
    ).withColumn("digest", F.lit("mine"))
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert out.count() <= docs.count()
            if k < 4:
                assert out.columns == docs.columns and {r.digest for r in out.collect()} <= {"mine"}
