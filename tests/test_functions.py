"""Scalar functions: golden values, round trips, edges and errors."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftflow.functions import codec, hashing, rng, strings

NAMES = "rs js pjw elf bkdr sdbm djb dek bp fnv ap".split()
# golden values, by the order of NAMES
GOLDEN = {
    "": [0, 1315423911, 0, 0, 0, 0, 5381, 0, 0, 0, 2863311530],
    "a": [97, 2935291981, 97, 97, 97, 97, 177670, 65, 97, 97, 3937053343],
    "apple": [1201423202, 1671125689, 6846245, 6846245, 3050411034, 1327380058, 253337143, 204066277, 505165413, 1939623600, 1607415766],
    "banana": [3816374183, 3942934392, 109594689, 109594689, 4264423013, 1739384549, 4086421542, 1109821856, 500725601, 2883025099, 2731786641],
    "orange": [2727779788, 1970436278, 124290261, 124290261, 3969143202, 3022476366, 319921761, 1494299780, 742110181, 2089424548, 690090035],
    "dog": [2218844730, 446369186, 27479, 27479, 1730744, 833432092, 193489663, 7559, 1652711, 898606624, 1032113975],
    "cat": [3010818258, 446368834, 27012, 27012, 1711762, 824252214, 193488125, 84, 1634548, 1285972338, 2401065292],
    "tiger": [3091529771, 1742390723, 8060354, 8060354, 40082951, 260309247, 275608064, 225775826, 1295643378, 175703573, 176640707],
    "é": [2492169462, 2762497448, 268431913, 268431913, 4294959218, 4290965670, 5857809, 4054, 7721, 3285292966, 1129797611],
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_simple_hashes(spark):
    df = spark.createDataFrame([(s,) for s in GOLDEN], "s string")
    for row in df.select("s", *(hashing.HASHES[n]("s").alias(n) for n in NAMES)).collect():
        assert list(row)[1:] == GOLDEN[row.s], row.s
        assert hashing.js_hash_of(row.s) == row.js


def test_md5(spark):
    golden = {"The quick brown fox jumps over the lazy dog": 0x82B62B379D7D109E, "The quick brown fox jumps over the lazy dog.": 0x1CFBD090C209D9E4, "": 0x04B2008FD98C1DD4}
    df = spark.createDataFrame([(s,) for s in golden], "s string").select("s", hashing.md5_64("s").alias("h"))
    assert {r.s: int(r.h) for r in df.collect()} == golden


def test_null_hashes_are_null(spark):
    row = one(spark, *(f(F.lit(None).cast("string")).alias(n) for n, f in hashing.HASHES.items()))
    assert set(row) == {None}


def test_shards(spark):
    words = "apple orange banana dog cat tiger".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    two = {r.w: r.s for r in df.select("w", hashing.shard_of("w", 2).alias("s")).collect()}
    three = {r.w: r.s for r in df.select("w", hashing.shard_of("w", 3).alias("s")).collect()}
    assert {w for w in words if two[w] == 0} == {"orange", "banana", "dog", "cat"}
    assert [{w for w in words if three[w] == k} for k in range(3)] == [{"banana"}, {"apple", "cat"}, {"orange", "dog", "tiger"}]
    with pytest.raises(KeyError):
        hashing.hash_function("JS")
    with pytest.raises(ValueError):
        hashing.shard_of("w", 0)


@pytest.mark.parametrize(
    "s, delimiters, expected",
    [(" apple \torange ", " \t", ["apple", "orange"]), (" apple orange ", " ", ["apple", "orange"]), ("apple", " ", ["apple"]), ("", " ", []), ("  ", " ", []), ("a]b^c-d\\e", "]^-\\", list("abcde")), ("x", "", ["x"])],
)
def test_split(spark, s, delimiters, expected):
    assert one(spark, strings.split_using(F.lit(s), delimiters))[0] == expected


def test_split_set_join_printf(spark):
    row = one(spark, strings.split_to_set(F.lit("b a b"), " "), strings.join_strings(F.array(F.lit("apple"), F.lit("banana"), F.lit("orange")), ","), strings.string_append(strings.string_printf("%d", F.lit(1)), "%d", F.lit(2)), strings.join_strings(F.array(F.lit("a"), F.lit("b"))))
    assert list(row) == [["a", "b"], "apple,banana,orange", "12", "a b"]


@pytest.mark.parametrize(
    "pattern, value, kind, expected",
    [
        ("<%d>", -5, "int", "<-5>"), ("<%i>", -5, "int", "<-5>"), ("<%5d|>", 42, "int", "<   42|>"), ("<%-5d|>", 42, "int", "<42   |>"), ("<%05d>", -42, "int", "<-0042>"), ("<%+d>", 42, "int", "<+42>"),
        ("<%ld>", 1 << 40, "long", "<1099511627776>"), ("<%lld>", -(1 << 40), "long", "<-1099511627776>"), ("<%hhd>", 7, "int", "<7>"), ("<%zd>", 7, "long", "<7>"),
        ("<%u>", 7, "int", "<7>"), ("<%u>", -1, "int", "<4294967295>"), ("<%lu>", -1, "long", "<18446744073709551615>"), ("<%llu>", 5, "long", "<5>"), ("<%08u>", 99, "int", "<00000099>"), ("<%03u>", 12345, "int", "<12345>"), ("<%-6u|>", 99, "int", "<99    |>"), ("<%6u>", 99, "int", "<    99>"),
        ("<%x>", 255, "int", "<ff>"), ("<%X>", -1, "int", "<FFFFFFFF>"), ("<%#x>", 255, "int", "<0xff>"), ("<%o>", 8, "int", "<10>"), ("<%c>", 65, "int", "<A>"), ("<%s>", "q%d", "string", "<q%d>"), ("<%.2s>", "abc", "string", "<ab>"), ("<%6.2f>", 3.14159, "double", "<  3.14>"), ("<%e>", 12.5, "double", "<1.250000e+01>"), ("100%% of %d%%", 3, "int", "100% of 3%"),
    ],
)
def test_printf_as_in_c(spark, pattern, value, kind, expected):
    assert one(spark, strings.string_printf(pattern, F.lit(value).cast(kind)))[0] == expected


def test_printf_errors(spark):
    assert one(spark, strings.string_printf("100%%"))[0] == "100%"
    for pattern, n in (("%d", 0), ("%d", 2), ("%*d", 2), ("%n", 1), ("%p", 1), ("%", 0)):
        with pytest.raises(ValueError):
            strings.string_printf(pattern, *[F.lit(1)] * n)


def test_hashes_of_many_keys_at_once():
    keys = [*GOLDEN, "x" * 300, "é漢" * 200, "", "\0"]
    assert hashing.js_hashes_of(pa.array(["cut off", *keys])[1:]).tolist() == [hashing.js_hash_of(k) for k in keys]
    assert hashing.js_hashes_of(pa.array([b"\xff", b""], pa.binary())).tolist() == [hashing.js_hash_of(b"\xff"), hashing.JS_SEED]
    assert len(hashing.js_hashes_of(pa.array([], pa.string()))) == 0


def test_keys(spark):
    row = one(spark, *(codec.to_key(F.lit(x)) for x in (0, 1, 123456789012)))
    assert list(row) == ["0000000000", "0000000001", "123456789012"]
    texts = ["0000000000", "0000000001", " \t-12abc", "abc", "", "99999999999", "+5"]
    assert list(one(spark, *(codec.from_key(F.lit(s), "int32") for s in texts))) == [0, 1, -12, 0, 0, 0, 5]
    assert one(spark, codec.from_key(F.lit("18446744073709551615"), "uint64"))[0] == (1 << 64) - 1
    with pytest.raises(Exception, match="not in the range"):
        one(spark, codec.to_key(F.lit(-1)))


@pytest.mark.parametrize("kind, values", [("int32", [0, 1, -1, -(1 << 31)]), ("uint32", [0, 1, 0xFFFFFFFF]), ("int64", [0, -1, -(1 << 63), (1 << 63) - 1]), ("uint64", [0, 1, (1 << 64) - 1])])
def test_bytes(spark, kind, values):
    for value in values:
        x = F.lit(str(value)).cast("decimal(20,0)")
        row = one(spark, codec.encode(x, kind).alias("b"), codec.decode(codec.encode(x, kind), kind).alias("x"))
        assert bytes(row.b) == value.to_bytes(4 if kind.endswith("32") else 8, "little", signed=kind[0] == "i")
        assert row.x == value


def test_wrong_bytes(spark):
    with pytest.raises(Exception, match="has 4 bytes"):
        one(spark, codec.decode(F.lit(b"abc"), "int32"))
    with pytest.raises(Exception, match="not in the range"):
        one(spark, codec.encode(F.lit(1 << 31), "int32"))


def test_random(spark):
    df = spark.range(1000).select(rng.rand_double(3).alias("d"), rng.rand_int(7, 3).alias("i"))
    rows = df.collect()
    assert rows == df.collect()
    assert {r.i for r in rows} == set(range(7)) and all(0 <= r.d < 1 for r in rows)
    assert 0 <= one(spark, rng.tick_count())[0] < 86_400_000
