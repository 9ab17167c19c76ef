"""Quality (op 7), languages (op 9) and url rules (op 8): held-out accuracy, odd rows, brute force."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from weftflow.llm import language, quality, url_filter
from weftflow.llm.queries import ORACLES, QUERIES, URL_RULES, quality_model

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scores(spark):
    return {r.doc_id: r for r in QUERIES["op7_quality"](spark, MIDDLE).collect()}


def test_quality_on_held_out_labels(spark, scores):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i].held_out for i in held) and sum(r.held_out for r in scores.values()) < len(scores) / 3
    right = np.mean([scores[i].predicted == labels[i] for i in held])
    assert right > 0.95
    clean = [i for i in held if labels[i] == 1]
    assert np.mean([scores[i].predicted for i in clean]) > 0.97


def test_quality_calibration_and_ranges(spark, scores):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = np.array([(scores[i].score, labels[i]) for i in labels if zlib.crc32(str(i).encode()) % 5 == 0])
    bins = np.minimum((held[:, 0] * 10).astype(int), 9)
    error = sum(abs(held[bins == k, 0].mean() - held[bins == k, 1].mean()) * (bins == k).mean() for k in set(bins))
    assert error < 0.05


def brute_score(model, text):
    """The score of one text, word by word and neuron by neuron."""
    found = [zlib.crc32(t.encode()) % quality.BUCKETS for t in quality.tokens(text)]
    x = np.zeros(quality.SIZE + 4)
    if found:
        x[: quality.SIZE] = sum(model.vectors[b].astype(float) for b in found) / len(found)
        x[quality.SIZE] = sum(a == b for a, b in zip(found, found[1:])) / max(1, len(found) - 1)
        x[quality.SIZE + 1 :] = [len(set(found)) / len(found) ** 0.5, np.log1p(len(found)), 1]
    w1, b1, w2, b2 = model.weights
    z = (x - model.mean) / model.scale
    hidden = [np.tanh(sum(z[i] * w1[i, j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
    return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, w2)) + b2[0]) / model.temperature))


def test_quality_scores_match_brute_force(spark):
    model = quality_model(spark, SMALL)
    texts = ["", "One two, THREE 44 ---- !!!!!!!!!!!!", "a  b\u00a0c\n\nd", "é漢 _x_ 12345678901", "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: round(r.score, 5) for r in quality.score(df, model).collect()} == {k: round(float(brute_score(model, t)), 5) for k, t in enumerate(texts)}


def test_quality_is_reproducible(spark, scores):
    again = QUERIES["op7_quality"](spark, MIDDLE).where("doc_id % 50 = 0").collect()
    assert all(abs(r.score - scores[r.doc_id].score) < 1e-6 for r in again)


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a null id"), (4, "word " * 50000), (5, "!!!"), (5, "!!!"), (6, "1234")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "label", "lang", "buckets", "accepted")})


def test_quality_of_odd_rows(spark):
    model = quality_model(spark, SMALL)
    out = quality.score(odd(spark), model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    kept = quality.keep(odd(spark), model).collect()
    assert {r.score for r in kept} <= {"mine"} and len(kept) == sum(r.score >= 0.3 for r in out)
    assert quality.score(odd(spark).limit(0), model).count() == quality.keep(odd(spark).limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = odd(spark)
    for labels in ([], [(1, None), (77, 1), (None, 1)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
        assert model is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.keep(docs, None).count() == 8
    one = quality.train(docs, spark.createDataFrame([(2, 1), (3, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, one).collect())


def test_labels_teach_only_where_allowed(spark):
    docs = spark.createDataFrame([(k, "good fine well" if k % 2 else "bad awful ### ###") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    wrong = labels.withColumn("quality", F.when(F.col("doc_id") < 100, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality.train(docs, wrong, F.col("doc_id") >= 100)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in quality.score(docs, model).collect())


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    out = QUERIES["op9_language"](spark, MIDDLE).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.98
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held if r.accepted]) > 0.99


@pytest.fixture(scope="module")
def languages():
    rows = [r for r in pq.read_table(f"{MIDDLE}/documents.parquet").to_pylist() if r["lang"] and r["text"]]
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    return language.fit([r["text"] for r in taught], [r["lang"] for r in taught]), [r for r in rows if r not in taught]


STRANGE = ["这是一个测试文档，其中包含一些中文句子。", "Это тестовый документ на русском языке.", "Αυτό είναι ένα έγγραφο δοκιμής", "xqzj vvkk wqpx zzkq jjxv", "これは日本語の文章です。", "한국어 문장입니다 그리고 더 많은 단어들", "זהו מסמך בדיקה בעברית"]


def test_rejection(languages):
    model, held = languages
    rng = np.random.default_rng(5)
    texts = [r["text"] for r in held]
    names, _, accepted = model.predict(texts)
    assert accepted.mean() >= 0.95 and np.mean([n == r["lang"] for n, r in zip(names, held)]) > 0.98
    assert model.predict([language.shuffled(t, rng) for t in texts])[2].mean() <= 0.05
    assert model.predict([t * k for t in STRANGE for k in (1, 3, 30)])[2].mean() <= 0.05
    assert 0.01 < model.temperature < 20 and 0 < model.reject_below < 1


def brute_prediction(model, text):
    found = brute_subwords(text)
    mean = sum(model.table[b].astype(float) for b in found) / max(1, len(found)) if found else np.zeros(model.table.shape[1])
    z = np.exp((mean[:-1] + model.bias) / model.temperature)
    bar = model.bars[sum(len(found) > s for s in language.SIZES)]
    if not any(c.isalpha() for c in text):
        return "und", 0.0, False
    best = int(np.argmax(z))
    score = z[best] / z.sum()
    return model.languages[best], round(score, 6), bool(score >= model.reject_below and mean[-1] >= bar)


def test_predictions_match_brute_force(languages, monkeypatch):
    model, held = languages
    texts = ["", "12 !", *STRANGE, *(r["text"][:3000] for r in held[:30]), "x" * 700]
    names, scores, accepted = model.predict(texts)
    assert list(zip(names, scores.round(6).tolist(), accepted.tolist())) == [brute_prediction(model, t) for t in texts]
    monkeypatch.setattr(language, "CHUNK", 100)  # in parts that end at gaps
    texts = [t for t in texts if "x" * 700 not in t]
    again = model.predict(texts)
    assert again[0] == [brute_prediction(model, t)[0] for t in texts] and np.allclose(again[1], [brute_prediction(model, t)[1] for t in texts], atol=1e-6)


def test_training_is_bounded(spark, monkeypatch):
    rows = [(k, f"wort{k} " * 30, f"l{k % 7}") for k in range(700)] + [(1000 + k, "z" * 70000, "long") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LANGUAGES", 3)
    monkeypatch.setattr(language, "TRAIN_BYTES", 9000)
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, names: seen.append((sum(map(len, texts)), set(names))))
    language.train(docs, F.lit(True))
    assert seen[0][1] <= {"l0", "l1", "l2"} and 0 < seen[0][0] < 20000


def test_languages_of_odd_rows(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 4, "xx"))
    docs = docs.union(spark.createDataFrame([(7, "ÀÉ İı ΣΑΣ ǅ 漢字", *["mine"] * 6)], docs.schema))
    model = language.train(docs, F.coalesce(F.col("doc_id") != 7, F.lit(True)))
    out = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()}
    assert out == {(1, "und"), (2, "und"), (3, "und"), (None, "xx"), (4, "xx"), (5, "und"), (6, "und"), (7, "xx")}
    assert language.train(docs.where("doc_id = 1"), F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def brute_subwords(text):
    out = []
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for word in words:
        for n in language.LENGTHS:
            marked = f" {word} "
            for k in range(len(marked) - n + 1):
                h = n * 0x85EBCA6B & 0xFFFFFFFF
                for c in marked[k : k + n]:
                    h = (h ^ ord(c) * 0x9E3779B1 & 0xFFFFFFFF) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                out.append(h % language.BUCKETS)
    return sorted(out)


def test_subwords_match_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "ab c", "é!ß 12 x", "İ Σς"] + ["".join(rng.choices("abé ñ.1漢 ", k=rng.randrange(20))) for _ in range(200)]
    at, row, some = language.subwords(texts)
    for k, text in enumerate(texts):
        assert sorted(at[row == k].tolist()) == brute_subwords(text), text
        assert some[k] == any(c.isalpha() for c in text)


def test_url_oracle(same):
    same(QUERIES["op8_url_filter"], ORACLES["op8_url_filter"])


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, 0, None, url_filter.DEFAULT)
    return host, path, best[3], best[4]


URLS = [None, "", "no scheme", "://", "http://", "http://com/en/", "HTTP://Example.COM/en/7?q", "x://a.example.com/en/71", "x://example.com/en/6", "x://notexample.com/en/7", "x://com.evil/en/", "x://a.net/de/#/x", "x://example.net/de/8", "x://u:p@b.org:80/es/", "x://é.org/es/ü", "x://org?/es/", "x://.org/es/", "x://org./es/", "a://b://c.org/es/", "x://a.org/es/\nz", "x://a.org/es/\0z", "x://a\0.net/de/", "x://" + "a." * 3000 + "org/es/"]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_urls_match_brute_force(spark, ranges):
    rng = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xexample.com", "net", "hot.net", ""]
    rules = [*URL_RULES] + [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b", "/a/b/c"])) for _ in range(40)] + [("block", None, "/"), ("block", "net", None)]
    urls = [*URLS] + [f"x://{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/b', '/a/bc', '/q', '/a/b/c/d'])}" for _ in range(600)] + ["x://hot.net/a/b"] * 400
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, "x://com/a"), (3, "x://com/a")], "page_id long, url string")
    pages = pages.withColumns({c: F.lit(1) for c in ("host", "path", "key", "range", "verdict")}).repartition(5)
    got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), ranges).collect()
    expected = [(k, *brute_verdict(u, rules)) for k, u in [*enumerate(urls), (None, "x://com/a"), (3, "x://com/a")]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "x://com/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_filter.judge(pages, none).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_a_hot_host_and_a_hot_url_fill_no_range(spark):
    urls = [f"x://hot.net/a/{k}" for k in range(2000)] + ["x://one.net/same"] * 2000 + [f"x://h{k}.net/" for k in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame(URL_RULES, "verdict string, host string, path string"), 12)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 3 * 500
