"""Token shards (op 1) and merge-replay BPE (op 4) against the libraries, on odd texts and tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftflow.llm import bpe_replay, pieces, simple8b, token_store
from weftflow.llm.pieces import cut, packed
from weftflow.llm.queries import QUERIES

RANKS = public.path("byte_bpe_multi_50k.tiktoken")
JSON = public.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n \ny", "x \ty z", "don't 's", "é漢😀 ß", "\xa0 x", "a　 b", "<|endoftext|> a", "aaaaaaaaaa", "z" * 5000, "\x1c \x1c", "a\x00b"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choices(" \n\t\x0b\x1c ab'sZ19é漢😀.,-\r\xa0\x85_", k=rng.randrange(15))) for _ in range(n)]


def test_pieces_give_the_library_ids(tiktoken_encoding, tokenizer):
    texts = [*ODD, *random_texts(3000)]
    for coder, expected in (
        (bpe_replay._encoder(RANKS, public.PATTERN), tiktoken_encoding.encode_ordinary),
        (token_store._encoder(JSON), lambda t: tokenizer.encode(t, add_special_tokens=False).ids),
    ):
        coded = coder if isinstance(coder, token_store.Encoder) else lambda some: packed(some, coder).to_pylist()
        for k in range(0, len(texts), 100):
            some = pa.array(["sliced off", *texts[k : k + 100]])[1:]
            assert [np.frombuffer(x, "<u4").tolist() for x in coded(some)] == [expected(t) for t in texts[k : k + 100]]


def test_added_tokens_are_the_librarys(tokenizer):
    """The content of an added token in a text is that token, wherever it stands."""
    end = "<|endoftext|>"
    rng = random.Random(9)
    texts = [end, end * 2, f"a{end}", f"{end}a", f"a {end} b", f"a  {end}  b", f"a \n{end}\n b", f"é{end}漢", "<|endoftext|", f"<{end}>", f"{end[:5]}{end}", "plain text"]
    texts += ["".join(rng.choices([end, " ", "a", "\n", "'s", "é", "word", "<|", "1"], k=rng.randrange(12))) for _ in range(3000)]
    got = token_store._encoder(JSON)(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(got[0], "<u4").tolist() == [50256]


def test_long_texts_in_parts(tokenizer, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 64)
    rng = random.Random(11)
    for _ in range(60):
        text = "".join(rng.choices([" ", "  ", "\n", "\xa0", "word", "é", "1234", "'s", "long" * 30, ". "], k=200))
        some = pa.array([text])
        assert np.frombuffer(token_store._encoder(JSON)(some)[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed(some, bpe_replay._encoder(RANKS, public.PATTERN))[0].as_py(), "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


def test_cut_loses_nothing():
    assert all("".join(cut(t)) == t for t in [*ODD, *random_texts(500)])


def test_replay_puts_back_what_a_lower_rank_overtakes():
    """A vocabulary in which a merge makes a pair of lower rank than its own."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"ab": 310, b"ca": 305, b"bca": 303}
    replay = bpe_replay.MergeReplay(ranks)
    one = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))).encode() for _ in range(2000)]
    for many in (1, 24):
        replay.MANY = many
        assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode(words)] == [one.encode_ordinary(w.decode()) for w in words]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for bits in range(65):
        values = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(max(0, 63 - bits))
        values[rng.random(500) < 0.3] = 0
        values[0] = np.uint64((1 << 64) - 1) if bits == 64 else values[0]
        words, escaped = simple8b.pack(values)
        assert (simple8b.unpack(words, escaped) == values).all()
    assert len(simple8b.pack(np.zeros(240))[0]) == 1
    for few in ([], [7], [0] * 241):
        assert simple8b.unpack(*simple8b.pack(np.array(few, dtype=np.uint64))).tolist() == few


def test_shard_file(monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 8)
    rng = np.random.default_rng(2)
    docs = [(k if k % 3 else None, rng.integers(0, 50000, rng.integers(0, 30))) for k in range(20)]
    out = io.BytesIO()
    writer = token_store.ShardWriter(out)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    data = out.getvalue()
    shard = token_store.Shard(io.BytesIO(data), len(data))
    assert [(i, x.tolist()) for i, _, x in shard.documents()] == [(i, x.tolist()) for i, x in docs]
    assert all(shard.ids(k).tolist() == docs[k][1].tolist() for k in range(20))
    for broken in (data[:-1], data[:-60] + b"x" + data[-59:]):
        with pytest.raises(ValueError):
            token_store.Shard(io.BytesIO(broken), len(broken))


ROWS = [(3, "c c"), (1, None), (1, ""), (None, "null id"), (2, "b " * 30000), (3, "c c"), (3, "c a"), (-5, "é")]


@pytest.fixture(scope="module")
def odd_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"ids": F.lit(1), "path": F.lit("x"), "start": F.lit(0), "n_tokens": F.lit(9), "decoded": F.lit(2)}).repartition(3)


def test_token_store_on_odd_rows(odd_table, tokenizer):
    manifest = token_store.write(odd_table, JSON, 2)
    ranks = {r.text: r.h for r in odd_table.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, ranks[r[1] or ""]))
    start, expected = 0, []
    for doc_id, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_store.digests(manifest).collect()), key=lambda r: r[1])
    assert got == expected
    assert sum(len(r.ids) for r in token_store.read(manifest).collect()) == start


def test_ids_of_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        token_store.write(spark.createDataFrame([("x", "y")], "doc_id string, text string"), JSON, 2)


def test_bpe_on_odd_rows(odd_table, tiktoken_encoding):
    out = bpe_replay.decode(bpe_replay.encode(odd_table, RANKS, public.PATTERN), RANKS).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    expected = [(i, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out), key=key) == sorted(expected, key=key)


def test_decoding_unknown_ids_fails(spark):
    with pytest.raises(Exception, match="vocabulary|out of bounds"):
        bpe_replay.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS).collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_store.write(empty, JSON, 2)
    assert manifest.count() == 0 and token_store.digests(manifest).count() == 0 and token_store.read(manifest).count() == 0
    assert bpe_replay.decode(bpe_replay.encode(empty, RANKS, public.PATTERN), RANKS).count() == 0


def test_queries(spark, tokenizer, tiktoken_encoding):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    start, stored, coded = 0, [], []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        stored.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        ids = tiktoken_encoding.encode_ordinary(text)
        coded.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op1_token_store"](spark, SMALL).collect())) == stored
    assert sorted(map(tuple, QUERIES["op4_bpe_replay"](spark, SMALL).collect())) == coded
