"""Mapper and reducer classes, routing, registries and counters."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftflow.functions import hashing
from weftflow.operators import mapping, reducing, registry, routing, sorting
from weftflow.operators.counters import Counters
from weftflow.sources import text


class Words(mapping.Mapper):
    def map(self, key, value):
        for word in value.split(" "):
            if word:
                self.output(word, "1")


class Combined(mapping.Mapper):
    def start(self):
        self.seen = Counter()

    def map(self, key, value):
        self.seen.update(filter(None, value.split(" ")))

    def flush(self):
        for word, n in self.seen.items():
            self.output(word, str(n))


class Sum(reducing.BatchReducer):
    def reduce(self, key, values):
        self.output(key, str(sum(map(int, values))))


class Fold(reducing.IncrementalReducer):
    def begin_reduce(self, key, value):
        return int(value)

    def partial_reduce(self, key, value, state):
        return state + int(value)

    def end_reduce(self, key, state):
        self.output(key, str(state))


class Hooks(reducing.BatchReducer):
    def start(self):
        self.output("", "start")

    def reduce(self, key, values):
        self.output(key, next(values))  # the other values are skipped

    def flush(self):
        self.output_to_channel(1, "", "flush")


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(1)
    vocabulary = "one two three four five é six漢 Seven".split()
    rows = [(str(k), " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for k in range(2000)]
    expected = Counter(w for _, line in rows for w in line.split())
    return spark.createDataFrame(rows, "key string, value string").repartition(3), expected


@pytest.mark.parametrize("shards", [1, 3, 5])
@pytest.mark.parametrize("mapper", [Words, Combined])
@pytest.mark.parametrize("reducer", [Sum, Fold])
def test_counts_do_not_depend_on_the_way(lines, shards, mapper, reducer):
    df, expected = lines
    context = mapping.Context(shards=shards)
    out = reducing.run_reducer(mapping.run_mapper(df, mapper, context), reducer, context, incremental=reducer is Fold).collect()
    assert {r.key: int(r.value) for r in out} == expected
    for shard in range(shards):  # byte order within a shard
        keys = [r.key.encode() for r in out if r.shard == shard]
        assert keys == sorted(keys)


def test_word_count_files(spark, tmp_path):
    once = "apple orange banana\n" * 3 + "dog cat tiger\n" * 3
    (tmp_path / "text-0").write_text(once)
    (tmp_path / "text-1").write_text(once + "\n\n")
    counters = Counters()
    read = counters.counted(text.read_text(spark, f"{tmp_path}/text-*", by_file=True), "in", F.count("key"))
    mapped = counters.counted(mapping.run_mapper(read, Words, mapping.Context(shards=2), by_file=True), "out")
    out = reducing.run_reducer(mapped, Sum, mapping.Context(shards=2)).collect()
    assert {r.key: r.value for r in out} == dict.fromkeys("apple banana cat dog orange tiger".split(), "6")
    assert counters.values() == {"in": 14, "out": 36}
    assert {r.key for r in out if r.shard == 1} == {"apple", "tiger"}


@pytest.mark.parametrize("rows", [[], [(2, "b", "x"), (2, "a", "y"), (2, "a", "z")]])
def test_shard_hooks_run_without_keys(spark, rows):
    df = spark.createDataFrame(rows, "shard int, key string, value string")
    out = reducing.run_reducer(df, Hooks, mapping.Context(shards=3, channels=2)).collect()
    assert sorted((r.shard, r.channel) for r in out if r.key == "") == [(k, c) for k in range(3) for c in range(2)]
    assert [(r.shard, r.key) for r in out if r.key] == ([(2, "a"), (2, "b")] if rows else [])


class PerFile(mapping.Mapper):
    files = 0

    def start(self):
        self.files += 1
        self.n = 0

    def map(self, key, value):
        self.n += 1

    def flush(self):
        self.output(self.current_file.rsplit("/", 1)[-1], str(self.n))


@pytest.mark.parametrize("tasks", [None, 1, 2])
def test_file_hooks_run_for_each_file(spark, tmp_path, tasks):
    for name, lines in (("a", "1\n2\n"), ("b", ""), ("c", "3\n"), ("d", "")):
        (tmp_path / name).write_text(lines)
    out = mapping.run_mapper(text.read_text(spark, f"{tmp_path}/*", by_file=True, tasks=tasks), PerFile, mapping.Context(map_only=True), by_file=True)
    assert sorted((r.key, r.value, r.shard) for r in out.collect()) == [("a", "2", None), ("b", "0", None), ("c", "1", None), ("d", "0", None)]


class Running(mapping.Mapper):
    """Its state goes on from file to file."""

    files = lines = 0

    def start(self):
        self.files += 1

    def map(self, key, value):
        self.lines += 1

    def flush(self):
        self.output(str(self.files), str(self.lines))


def test_state_goes_on_over_the_files_of_a_task(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}").write_text("x\n" * k)
    read = text.read_text(spark, f"{tmp_path}/f*", by_file=True, tasks=1)
    out = mapping.run_mapper(read, Running, mapping.Context(map_only=True), by_file=True).collect()
    assert [(r.key, r.value) for r in out] == [("1", "0"), ("2", "1"), ("3", "3"), ("4", "6"), ("5", "10")]
    assert text.read_text(spark, f"{tmp_path}/f*", by_file=True, tasks=2).rdd.getNumPartitions() == 2


def test_default_shards_are_those_of_the_expression(spark):
    keys = ["", "a", "é漢", "x" * 300, "word"]
    df = spark.createDataFrame([(k, k) for k in keys], "key string, value string")

    class Same(mapping.Mapper):
        def map(self, key, value):
            self.output(key, value)

    out = mapping.run_mapper(df, Same, mapping.Context(shards=7))
    assert out.where(F.col("shard") != hashing.shard_of("key", 7)).count() == 0 and out.count() == 5
    with pytest.raises(Exception, match="shard outside"):
        class Bad(Same):
            def shard(self, key, shards):
                return -1

        routing.checked(mapping.run_mapper(df, Bad, mapping.Context(shards=7)), 7).collect()


class Everywhere(mapping.Mapper):
    def map(self, key, value):
        self.output_to_all_shards(key, value)
        self.output_to_shard(2, key, "two")


class Wrong(mapping.Mapper):
    def map(self, key, value):
        self.output_to_shard(int(value), key, value)


class Own(mapping.Mapper):
    def shard(self, key, shards):
        return shards - 1

    def map(self, key, value):
        self.output(key, value)


def test_routing_by_mappers(spark):
    df = spark.createDataFrame([("k", "1")], "key string, value string")
    out = mapping.run_mapper(df, Everywhere, mapping.Context(shards=3)).collect()
    assert sorted((r.shard, r.value) for r in out) == [(0, "1"), (1, "1"), (2, "1"), (2, "two")]
    assert mapping.run_mapper(df, Own, mapping.Context(shards=3)).first().shard == 2
    for shard in ("3", "-1"):
        with pytest.raises(Exception, match="shard outside"):
            mapping.run_mapper(df.withColumn("value", F.lit(shard)), Wrong, mapping.Context(shards=3)).collect()
    with pytest.raises(Exception, match="map-only"):
        mapping.run_mapper(df, Everywhere, mapping.Context(map_only=True)).collect()


def test_routing_by_expression(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4).cast("int").alias("shard"))
    placed = routing.to_shards(df, 4).withColumn("p", F.spark_partition_id()).collect()
    assert all(r.shard == r.p for r in placed) and len(placed) == 100
    for wrong in (F.lit(4), F.lit(-1), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="shard outside"):
            routing.to_shards(df.withColumn("shard", wrong), 4).collect()
    assert sorted(map(tuple, routing.to_all_shards(df.drop("shard"), 3).groupBy("shard").count().collect())) == [(k, 100) for k in range(3)]
    ordered = [r.id for r in routing.by_range(spark.range(1000).orderBy(F.rand(1)), 4, "id").collect()]
    assert ordered == list(range(1000))


def test_different_reducers_by_shard(spark):
    df = spark.createDataFrame([(0, "a", "1"), (0, "a", "2"), (1, "b", "5"), (1, "b", "7")], "shard int, key string, value string")
    out = reducing.run_reducer(df, [Sum, Hooks], mapping.Context(shards=2, channels=2)).collect()
    assert ("a", "3") in {(r.key, r.value) for r in out} and {r.value for r in out if r.key == "b"} <= {"5", "7"}
    with pytest.raises(ValueError):
        reducing.run_reducer(df, [Sum], mapping.Context(shards=2))


def test_channel_range(spark):
    df = spark.createDataFrame([(0, "a", "1")], "shard int, key string, value string")
    with pytest.raises(Exception, match="channel outside"):
        reducing.run_reducer(df, Hooks, mapping.Context(shards=1, channels=1)).collect()


def test_binary_keys_and_nulls(spark):
    df = spark.createDataFrame([(b"\xff", b"1"), (b"\x00", b"2"), (None, b"3")], "key binary, value binary")
    context = mapping.Context(shards=2)
    out = reducing.run_reducer(mapping.run_mapper(df, Own, context, kind="binary"), reducing_first(), context, kind="binary").collect()
    assert [bytes(r.key) for r in out] == [b"", b"\x00", b"\xff"]


def reducing_first():
    class First(reducing.BatchReducer):
        def reduce(self, key, values):
            self.output(key, next(values))

    return First


def test_fold_expression(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5)], "key string, value long")
    out = reducing.fold(df, F.lit(1).cast("long"), lambda s, v: s * v, lambda s: -s)
    assert dict(out.collect()) == {"a": -12, "b": -5}


def test_fold_with_combined_states(spark, monkeypatch):
    monkeypatch.setattr(reducing, "PART", 7)
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("value")).repartition(5)
    out = reducing.fold(df, F.lit(0).cast("long"), lambda s, v: s + v, lambda s: -s, combine=lambda a, b: a + b)
    assert dict(out.collect()) == {str(k): -sum(range(k, 1000, 3)) for k in range(3)}


def test_registries():
    own = registry.Registry("thing")

    @own("One")
    class One: ...

    assert isinstance(own.create("One"), One) and "One" in own
    for name in ("One ", "", "one"):
        with pytest.raises(KeyError):
            own.create(name)

    @own("One")
    class Other: ...

    assert own.find("One") is Other
    assert registry.Registry("other").classes == {}
    assert isinstance(registry.Registry("thing", default=One).create("anything"), One)


def test_passes_and_union(spark):
    df = spark.createDataFrame([("a", "1")], "key string, value string")
    assert mapping.passes(df, 3).count() == 3
    assert mapping.union_of(df, df).count() == 2
    assert mapping.emit(df, F.upper("key"), F.col("value"), F.col("value") == "1").collect() == [("A", "1")]


@pytest.mark.parametrize("kind", ["string", "binary"])
@pytest.mark.parametrize("run", [1, 3000, 1 << 20])
def test_rows_in_order_by_runs(monkeypatch, kind, run):
    for name, value in (("RUN", run), ("BLOCK", 500), ("FAN", 3)):
        monkeypatch.setattr(sorting, name, value)
    rng = random.Random(run)
    rows = [(rng.choice(["the", "", "é", "漢", "\U0001f600", "\uffff", str(rng.randrange(300))]), "x" * rng.choice([0, 1, 2000])) for _ in range(3000)]
    if kind == "binary":
        rows = [(key.encode(), value.encode()) for key, value in rows]
    given = pa.table({"key": pa.array([k for k, _ in rows], kind), "value": pa.array([v for _, v in rows], kind)}).to_batches(max_chunksize=70)
    blocks = [list(zip(*(c.to_pylist() for c in block.columns))) for block in sorting.in_order(given)]
    out = [row for block in blocks for row in block]
    keys = [key if kind == "binary" else key.encode() for key, _ in out]
    assert keys == sorted(keys) and Counter(out) == Counter(rows) and len(blocks) > 100
    assert list(sorting.in_order([])) == list(sorting.in_order(given[0].slice(0, 0) for _ in range(2))) == []


def test_rows_in_order_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(sorting, "RUN", 1 << 20)
    monkeypatch.setattr(sorting, "BLOCK", 1 << 14)

    def most(batches: int) -> int:
        before = pa.total_allocated_bytes()
        held = [0]

        def given():
            rng = random.Random(1)
            for _ in range(batches):
                yield pa.record_batch([pa.array([f"{rng.random()}" for _ in range(2000)]), pa.array(["1"] * 2000)], names=["key", "value"])
                held.append(pa.total_allocated_bytes() - before)

        for _ in sorting.in_order(given()):
            held.append(pa.total_allocated_bytes() - before)
        return max(held)

    few, many = most(40), most(400)
    assert many < 8 << 20 and many < 2 * few


@pytest.mark.parametrize("reducer", [Sum, Fold])
def test_shards_are_not_sorted_in_the_memory_of_a_task(lines, reducer):
    context = mapping.Context(shards=3)
    out = reducing.run_reducer(mapping.run_mapper(lines[0], Words, context), reducer, context, incremental=reducer is Fold)
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
