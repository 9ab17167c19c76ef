"""Exact duplicates (op 3), SimHash (op 6) and connected components, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from weftflow.llm import common, exact_dedup, secret_ledger, simhash
from weftflow.llm.common import mark_of, new_path, written
from weftflow.llm.components import components
from weftflow.llm.queries import ORACLES, QUERIES


def test_exact_oracle(same):
    same(QUERIES["op3_exact_dedup"], ORACLES["op3_exact_dedup"])


ROWS = [(5, "a b"), (4, "ab"), (4, "ab"), (3, "a\tb"), (9, None), (8, ""), (7, " "), (None, "q"), (None, "q"), (2, "q"), (1, "Q"), (6, "x" * 100000)]


def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("digest", "check", "size", "row", "chars", "norm", "nth", "fp", "copies")}).repartition(4)


def test_exact_on_odd_rows(spark):
    out = exact_dedup.duplicates(odd(spark)).collect()
    kept = sorted((r.keep_id, r.group_size) for r in out if r.kept)
    assert len(out) == len(ROWS)
    # of "a b", "ab" and "a\tb" the longer with the smaller id; the blank is longer than empty texts; id 2 before null
    assert kept == [(1, 1), (2, 3), (3, 4), (6, 1), (7, 3)]
    rows = exact_dedup.keep(odd(spark)).collect()
    assert sorted((r.doc_id, r.text[:3]) for r in rows) == [(1, "Q"), (2, "q"), (3, "a\tb"), (6, "xxx"), (7, " ")]
    assert rows[0].digest == 1 and len(rows[0]) == 11


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(None, "q")] * 3 + [(1, "z")] * 3, "doc_id long, text string")
    assert sorted(r.text for r in exact_dedup.keep(df).collect()) == ["q", "z"]
    assert sum(r.kept for r in exact_dedup.duplicates(df).collect()) == 2


def test_many_runs_and_a_hot_digest(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text")).repartition(70)
    out = exact_dedup.duplicates(df).toPandas()
    expected = df.toPandas().assign(size=lambda d: d.groupby("text").doc_id.transform("size"), first=lambda d: d.groupby("text").doc_id.transform("min")).set_index("doc_id")
    out = out.set_index("doc_id")
    assert (out.keep_id == expected["first"].reindex(out.index)).all() and (out.group_size == expected["size"].reindex(out.index)).all()
    assert (out.kept == (out.index == out.keep_id)).all()


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicates(empty).count() == exact_dedup.keep(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.keep(empty).count() == 0


def brute_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_classes(fps):
    """Label of each fingerprint's class: an equal pair of labels means tied."""
    values = np.array(fps, dtype=np.uint64)
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 3) + k + 1:
            label[max(root(k), root(int(j)))] = min(root(k), root(int(j)))
    return [root(k) for k in range(len(fps))]


def test_simhash_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    expected = [(i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, brute_classes(fps))]
    assert sorted(map(tuple, QUERIES["op6_simhash"](spark, SMALL).collect())) == expected


def test_simhash_odd_texts(spark):
    texts = [None, "", " \t", "One", "one two", "ONE two", "a b c d", "É a b", "w " * 40000, "some words " * 150000 + "x" * 1200000 + " at the end"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "one two"), (3, "One")], "doc_id long, text string")
    out = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df.withColumn("fp", F.lit(0))).collect()}
    assert {(0, "0" * 16, 0), (1, "0" * 16, 0), (2, "0" * 16, 0)} <= out
    assert {f for i, f, _ in out if i is not None} == {f"{brute_fingerprint(t):016x}" for t in texts}
    assert (None, f"{brute_fingerprint('one two'):016x}", 4) in out
    kept = simhash.keep(df.withColumn("component_id", F.lit("mine"))).collect()
    assert all(r.component_id == "mine" for r in kept) and {r.doc_id for r in kept} >= {0, 3, 4} and 5 not in {r.doc_id for r in kept}


@pytest.mark.parametrize("limit", [simhash.LIMIT, 20])
def test_links_of_clusters(spark, limit):
    """Chains and balls of fingerprints; with a low limit, crowded blocks take the finer split."""
    rng = random.Random(4)
    fps = set()
    for size in (300, 60, 5, 1):
        base = rng.getrandbits(64)
        for _ in range(size):
            fps.add(base)
            base ^= sum(1 << b for b in rng.sample(range(12 if size == 300 else 64), rng.choice((1, 2, 3, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())
    roots = {r.node: r.root for r in components(edges).collect()}
    ours = [roots.get(f, f) for f in signed]
    assert len(set(zip(ours, brute_classes(fps)))) == len(set(ours)) == len(set(brute_classes(fps)))


def test_every_close_pair_shares_a_key():
    for blocks, kept, most in ((5, 2, None), (8, 5, None), (16, 13, 1 << 12)):
        chosen = simhash.masks(blocks, kept)
        rng = random.Random(6)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flip & (m & (1 << 64) - 1) == 0 for m in chosen)
        if most:
            assert all(1 << (64 - bin(m & (1 << 64) - 1).count("1")) <= most for m in chosen)


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == label[n] for n in label)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_fill_no_task(spark):
    """A third of all rows are equal and adaptive execution is off: no partition of a result is crowded."""
    hot = F.when(F.col("id") % 3 == 0, "token=abcdef12 one two three").otherwise(F.concat(F.lit("own words of number "), F.col("id")))
    df, _ = written(spark.range(60000).select(F.col("id").alias("doc_id"), hot.alias("text")).repartition(8), "hot")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (exact_dedup.duplicates(df), secret_ledger.scan(df, new_path(spark, "ledger")), simhash.near_duplicates(df)):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 60000 and max(sizes) < 2 * 40000 / 4
        edges = spark.range(1, 30000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        assert components(edges).where("root = 0").count() == 29999
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_filtered_rows_are_exact_whatever_the_filter_lets_through(spark, monkeypatch):
    rows = [(k % 50 if k % 7 else None, f"t{k % 90}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine"))
    marked = df.select("doc_id", mark_of(F.col("text")).alias("mark"), "text").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    listed = marked.where("doc_id is null or doc_id % 3 = 0").withColumn("stays", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    goes = {(r.doc_id, r.text): r.stays for r in listed.collect()}
    expected = sorted([r for r in rows if r not in goes] + [k for k, stays in goes.items() if stays], key=repr)
    for share in (0.02, 0.99):
        monkeypatch.setattr(common, "FALSE_HITS", share)
        for few in (100, 2):
            monkeypatch.setattr(common, "FEW", few)
            tables = common.Tables(spark)
            got = common.without(df, listed.drop("text"), tables).collect()
            assert sorted([(r.doc_id, r.text) for r in got], key=repr) == expected and {r.row for r in got} == {"mine"}
        got = common.only(df, listed.select("doc_id", "mark"), common.Tables(spark)).collect()
        assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(goes, key=repr)


def test_rounds_grow_with_the_number_of_runs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 701).alias("text")).repartition(90)
    digests, _ = written(exact_dedup.digest(df), "digests")
    for runs in (1, 8, 33, 90):
        best = {r.best.doc_id: r.rows for r in exact_dedup.merged(digests, runs).collect()}
        assert best == {k: 4 + (k + 4 * 701 < 3000) for k in range(701)}
