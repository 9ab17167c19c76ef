"""Registered queries over the driver's tables, one or more for each operator.

Native queries are plain DataFrame plans; those that run mapper and reducer classes say so in their names or
docstrings. All read whole tables. DuckDB equivalents are in :mod:`weftflow.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, hashing, rng, strings
from ..operators import mapping, reducing, registry, routing
from ..operators.counters import Counters
from ..sources import formats, records, text
from ..sources.paths import scratch
from ..streaming import incremental
from . import job
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Tables of up to so many rows and bytes of text are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array() -> Column:
    return strings.split_using("text", " ")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of all documents, on all cores even where they are one split."""
    return routing.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.explode(word_array()).alias("word"))


# word counts


@query
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


class CountingMapper(mapping.Mapper):
    """Counts words as it goes and emits the counts when a file ends, or when it holds many."""

    def start(self):
        self.counts = {}

    def map(self, key, value):
        for word in value.split(" "):
            if word:
                self.counts[word] = self.counts.get(word, 0) + 1
        if len(self.counts) > 100_000:
            self.flush()

    def flush(self):
        for word, n in self.counts.items():
            self.output(word, str(n))
        self.counts = {}


class SumReducer(reducing.BatchReducer):
    def reduce(self, key, values):
        self.output(key, str(sum(map(int, values))))


class SumFold(reducing.IncrementalReducer):
    def begin_reduce(self, key, value):
        return int(value)

    def partial_reduce(self, key, value, state):
        return state + int(value)

    def end_reduce(self, key, state):
        self.output(key, str(state))


def _as_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))  # dealt by run_mapper


def _counts(reduced: DataFrame) -> DataFrame:
    return reduced.select(F.col("key").alias("word"), F.col("value").cast("long").alias("n"))


@query
def wordcount_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper class that combines before the shuffle; the sums are a native aggregation."""
    mapped = mapping.run_mapper(_as_kv(spark, sf_dir), CountingMapper, mapping.Context(shards=8))
    return mapped.groupBy(F.col("key").alias("word")).agg(F.sum(F.col("value").cast("long")).alias("n"))


@query
def wordcount_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapper and batch reducer classes over explicit shards."""
    context = mapping.Context(shards=8)
    return _counts(reducing.run_reducer(mapping.run_mapper(_as_kv(spark, sf_dir), CountingMapper, context), SumReducer, context))


@query
def wordcount_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an incremental reducer class."""
    context = mapping.Context(shards=8)
    return _counts(reducing.run_reducer(mapping.run_mapper(_as_kv(spark, sf_dir), CountingMapper, context), SumFold, context, incremental=True))


@query
def wordcount_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold as a Column expression; the states of a key's parts are combined."""
    pairs = mapping.emit(texts(spark, sf_dir), F.explode(word_array()), F.lit(1).cast("long"))
    folded = reducing.fold(pairs, F.lit(0).cast("long"), lambda state, value: state + value, combine=lambda a, b: a + b)
    return folded.select(F.col("key").alias("word"), F.col("value").alias("n"))


@query
def bigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place of a text but the last, so that words are paired in compiled code."""
    array = texts(spark, sf_dir).select(word_array().alias("w")).where(F.size("w") > 1)
    placed = array.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("k"))
    bigram = F.concat(F.get("w", F.col("k")), F.lit(" "), F.get("w", F.col("k") + 1))
    return placed.select(bigram.alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


# map only


@query
def map_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query
def map_only_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", revenue)


@query
def multi_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the input: counts are three times those of one."""
    return mapping.passes(table(spark, sf_dir, "nation"), 3).groupBy(F.col("n_name").alias("word")).agg(F.count("*").alias("n"))


# routing


@query
def shard_histogram_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per shard of the default partitioner; each distinct word is hashed once."""
    return wordcount(spark, sf_dir).groupBy(hashing.shard_of("word", 4).alias("shard")).agg(F.sum("n").alias("n"))


@query
def custom_shard_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(7))
    dealt = routing.checked(routing.with_shard(table(spark, sf_dir, "orders"), 8, shard=shard), 8)
    return dealt.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def output_to_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit shards, and the partitions that rows are then found in."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") % 8).cast("int").alias("shard"))
    placed = routing.to_shards(orders, 8, key=None).select("shard", F.spark_partition_id().alias("partition"))
    return placed.groupBy("shard", "partition").agg(F.count("*").alias("n"))


@query
def output_to_all_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = routing.to_all_shards(table(spark, sf_dir, "nation"), 3)
    return routing.to_shards(spread, 3, "n_name").select("shard", "n_nationkey", "n_name")


@query
def channel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output to three channels, written in one pass and read back by channel."""
    path = scratch(spark, "channels")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("channel"), F.col("event_type").alias("value"))
    formats.write_by_channel(events, 3, path)
    return spark.read.schema("value string, channel int").text(path).groupBy("channel", F.col("value").alias("event_type")).agg(F.count("*").alias("n"))


@query
def topk_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest lines of each shard."""
    shard = (F.col("l_suppkey") % 4).cast("int").alias("shard")
    items = table(spark, sf_dir, "lineitem").select(shard, "l_orderkey", "l_linenumber", "l_extendedprice")
    order = Window.partitionBy("shard").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return items.withColumn("nth", F.row_number().over(order)).where("nth <= 3").select("shard", "nth", "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def range_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order over eight shards, and how often it is broken: within shards and between neighbours."""
    row = F.struct("o_totalprice", "o_orderkey")
    dealt = routing.by_range(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), 8, "o_totalprice", "o_orderkey")
    placed = dealt.select("o_orderkey", row.alias("row"), F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("row").over(Window.partitionBy("shard").orderBy("at"))
    shards = placed.withColumn("broken", F.coalesce(before > F.col("row"), F.lit(False))).groupBy("shard")
    shards = shards.agg(F.min("row").alias("least"), F.max("row").alias("most"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_if("broken").alias("broken"))
    # one row for each of the eight shards
    gap = F.coalesce(F.lag("most").over(Window.orderBy("shard")) > F.col("least"), F.lit(False))
    return shards.withColumn("gap", gap).agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.sum("broken").alias("rows_out_of_order"), F.count_if("gap").alias("shards_out_of_order"))


# reductions


@query
def identity_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mapping.emit(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), F.col("c_name"))
    return routing.to_shards(routing.with_shard(pairs, 4), 4).select("key", "value")


@query
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key")).distinct()


@query
def sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "key")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    return reducing.grouped(items, F.sum(F.col("l_quantity").cast("long")).alias("quantity"), cents)


@query
def min_max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "key")
    return reducing.grouped(items, F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query
def avg_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "key")
    return reducing.grouped(items, F.round(F.sum(F.col("l_quantity").cast("long")) / F.count("*"), 6).alias("mean"))


@query
def collect_sorted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    return reducing.grouped(orders, F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("value"))


@query
def union_heterogeneous_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = mapping.emit(table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string"), F.lit("c"))
    suppliers = mapping.emit(table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("string"), F.lit("s"))
    return reducing.grouped(mapping.union_of(customers, suppliers), F.count("*").alias("n"))


class CountReducer(reducing.BatchReducer):
    def reduce(self, key, values):
        self.output(key, str(sum(1 for _ in values)))


class MaxReducer(reducing.BatchReducer):
    def reduce(self, key, values):
        self.output(key, str(max(map(int, values))))


@query
def heterogeneous_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reducer classes, one for each shard."""
    orders = table(spark, sf_dir, "orders")
    pairs = orders.select((F.col("o_custkey") % 2).cast("int").alias("shard"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value"))
    return reducing.run_reducer(pairs, [CountReducer, MaxReducer], mapping.Context(shards=2)).select("shard", "key", "value")


class LinesReducer(reducing.BatchReducer):
    """Says when a shard starts and ends, keys or not."""

    def start(self):
        self.output("", "start")

    def flush(self):
        self.output("", "flush")

    def reduce(self, key, values):
        self.output(key, f"{key} {sum(1 for _ in values)}")


@query
def reducer_start_flush_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer class whose hooks emit, over four shards of which some have no keys."""
    events = mapping.emit(table(spark, sf_dir, "events"), F.col("event_type"), F.lit(""))
    return reducing.run_reducer(routing.with_shard(events, 4), LinesReducer, mapping.Context(shards=4)).select("shard", "value")


# joins and sets


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")


@query
def reduce_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_name", "o_orderstatus")


@query
def reduce_side_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(_pending(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query
def reduce_side_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(_pending(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query
def reduce_side_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(_pending(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def reduce_side_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    ordered = _pending(spark, sf_dir).select("o_custkey").distinct()
    return customers.join(ordered, F.col("o_custkey") == F.col("c_custkey"), "full").select(F.col("c_custkey").alias("customer"), F.col("o_custkey").alias("ordered"))


@query
def broadcast_join_all_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small side goes to all tasks if it is small (its rows and bytes are counted), else both are shuffled."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    size = nations.agg(F.count("*").alias("rows"), F.sum(F.octet_length("n_name")).alias("bytes")).first()
    if size.rows <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        nations = F.broadcast(nations)
    per_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return per_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"))


@query
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


# scalar functions


def _hash_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", hashing.hash_function(name)("p_name").alias("hash"))

    return run


QUERIES |= {f"hash_{name}": _hash_query(name) for name in hashing.HASHES}


@query
def split_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = texts(spark, sf_dir).select("doc_id", strings.split_to_set("text", " ").alias("set"))
    return sets.select("doc_id", F.size("set").cast("long").alias("n"), strings.join_strings("set").alias("words"))


@query
def join_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.join_strings(F.array("p_brand", "p_type", "p_name"), "|").alias("joined"))


@query
def printf_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.string_append(F.col("p_brand"), "-%010d", "p_partkey").alias("key"))


@query
def int_to_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.to_key("o_orderkey").alias("key"))


@query
def key_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from a key, from a number with text after it, and from no number."""
    prefix = codec.from_key(F.concat(F.lit(" \t"), F.col("o_custkey").cast("string"), F.lit("abc")), "int32")
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.from_key(codec.to_key("o_orderkey")).alias("number"), prefix.alias("prefix"), codec.from_key(F.lit("x"), "int32").alias("none"))


@query
def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian bytes of negative numbers, and back."""
    encoded = table(spark, sf_dir, "orders").select("o_orderkey", codec.encode((-F.col("o_custkey")).cast("int"), "int32").alias("b"))
    return encoded.select("o_orderkey", F.hex("b").alias("bytes"), codec.decode("b", "int32").alias("number"))


@query
def random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random numbers are in range, spread out and the same for a seed; ticks are milliseconds of a day."""
    drawn = table(spark, sf_dir, "part").select(rng.rand_double(7).alias("unit"), rng.rand_double(7).alias("again"), rng.rand_int(10, 8).alias("whole"), rng.tick_count(F.timestamp_seconds(F.lit(86400 * 3 + 5))).alias("tick"))
    return drawn.agg(
        F.count("*").alias("n"),
        F.bool_and((F.col("unit") >= 0) & (F.col("unit") < 1)).alias("unit_in_range"),
        F.bool_and(F.col("whole").between(0, 9)).alias("whole_in_range"),
        (F.abs(F.avg("unit") - 0.5) < 0.1).alias("unit_centred"),
        (F.count_distinct("whole") == 10).alias("all_wholes"),
        F.bool_and(F.col("unit") == F.col("again")).alias("same_for_a_seed"),
        F.max("tick").alias("tick"),
    )


@query
def printf_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C conversions with flags, lengths and unsigned numbers."""
    size = F.col("p_size").cast("int")
    key = F.col("p_partkey").cast("long")
    line = strings.string_printf("%05u|%i|%-12lld|%x|%lu|%u|%c|%.3s|100%%", size, -size, key, size, -key, -size, size + 64, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query
def codec_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and sortable keys of all four integer types, there and back."""
    key = F.col("o_orderkey").cast("decimal(20,0)")
    numbers = {
        "int32": (-F.col("o_custkey")).cast("int"),
        "uint32": F.lit(4294967295) - F.col("o_orderkey"),
        "int64": F.col("o_orderkey").cast("long") * -10_000_000_000,
        "uint64": F.lit("18446744073709551615").cast("decimal(20,0)") - key,
    }
    columns = []
    for kind, x in numbers.items():
        columns += [F.hex(codec.encode(x, kind)).alias(f"{kind}_bytes"), (codec.decode(codec.encode(x, kind), kind) == x).alias(f"{kind}_back")]
        if kind.startswith("uint"):
            columns += [codec.to_key(x, kind).alias(f"{kind}_key"), (codec.from_key(codec.to_key(x, kind), kind) == x).alias(f"{kind}_key_back")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *columns)


# files


@query
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    text.write_text(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), path)
    return text.read_values(spark, path).select("value")


@query
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines keyed by offset, read in byte ranges that cut through lines."""
    path = scratch(spark, "offsets")
    text.write_text(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), path)
    lines = text.read_text(spark, path, split=50_000)
    return lines.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sum(F.octet_length("value") + 1).alias("bytes"))


@query
def protofile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    pairs = mapping.emit(table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_name"))
    records.write(pairs, path)
    read = records.read(spark, path, key=lambda c: c.cast("string"), value=lambda c: c.cast("string"))
    return read.select("key", "value")


class LineCounter(mapping.Mapper):
    def start(self):
        self.lines = 0

    def map(self, key, value):
        self.lines += 1

    def flush(self):
        self.output(self.current_file, str(self.lines))


@query
def per_file_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper class whose hooks run once for each of three files."""
    path = scratch(spark, "files")
    text.write_text(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).repartition(3), path)
    mapped = mapping.run_mapper(text.read_text(spark, path, by_file=True), LineCounter, mapping.Context(map_only=True), by_file=True)
    return mapped.agg(F.count("*").alias("files"), F.sum(F.col("value").cast("long")).alias("lines"))


@query
def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through a buffer of 24 bytes: longer ones become as many empty values as buffers they fill."""
    path = scratch(spark, "strict")
    text.write_text(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), path)
    return text.read_text(spark, path, strict=True, max_line=24).groupBy("value").agg(F.count("*").alias("n"))


# jobs


@registry.mapper("weftflow.words")
class WordsMapper(mapping.Mapper):
    def map(self, key, value):
        for word in value.split(" "):
            if word:
                self.output(word, "1")


@registry.batch_reducer("weftflow.sums")
class SumLines(reducing.BatchReducer):
    """Text output holds values only, so the word goes into the value."""

    def reduce(self, key, values):
        self.output(key, f"{key} {sum(map(int, values))}")


@registry.incremental_reducer("weftflow.sums")
class SumLinesFold(SumFold):
    def end_reduce(self, key, state):
        self.output(key, f"{key} {state}")


def _job(spark: SparkSession, sf_dir: str, mapper: str, reducer: str, column: str, *switches: str) -> DataFrame:
    """The output of a textual job over a column of ``part``, written as a text file."""
    folder = scratch(spark, "job")
    text.write_text(table(spark, sf_dir, "part").select(F.col(column).alias("value")), f"{folder}/in")
    found = job.parse([f"--mapreduce_map_io={{a,b}}:{mapper}:text:{folder}/in/part-*:/none", f"--mapreduce_reduce_io={{a,b,c}}:{reducer}:/none:text:{folder}/out", *switches])
    job.run(spark, found.job())
    return spark.read.schema("value string").text(f"{folder}/out")


@query
def job_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job in textual form: classes by name, three shards, one output path."""
    return _job(spark, sf_dir, "weftflow.words", "weftflow.sums", "p_name")


@query
def job_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in incremental mode, where the name means another class."""
    return _job(spark, sf_dir, "weftflow.words", "weftflow.sums", "p_name", "--mapreduce_incremental_mode")


def _values_reader(spark: SparkSession, patterns: str | list[str], by_file: bool = False, **options) -> DataFrame:
    return text.read_values(spark, patterns).select(F.lit("").alias("key"), "value", "file")


def _loud_writer(df: DataFrame, path: str) -> None:
    text.write_text(df.select(F.upper(F.col("value").cast("string")).alias("value")), path)


formats.register_reader("weftflow.values", _values_reader)
formats.register_writer("weftflow.loud", _loud_writer)


@query
def job_own_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map-only job whose reader and writer are registered by name; its second run replaces what the first wrote."""
    folder = scratch(spark, "own")
    text.write_text(table(spark, sf_dir, "part").select(F.col("p_brand").alias("value")), f"{folder}/in")
    made = job.Job((job.MapTask("weftflow.words", f"{folder}/in", "weftflow.values", "weftflow.loud", f"{folder}/out"),))
    for _ in range(2):
        job.run(spark, made)
    return spark.read.schema("value string").text(f"{folder}/out")


@registry.batch_reducer("weftflow.channels")
class ChannelsReducer(reducing.BatchReducer):
    """Keys go to the first channel, and the number of each key's values to the second."""

    def reduce(self, key, values):
        self.output(key, key)
        self.output_to_channel(1, key, f"{key} {sum(1 for _ in values)}")


@query
def job_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reducers, each with a path for either of its channels, written in one pass."""
    folder = scratch(spark, "channels")
    text.write_text(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), f"{folder}/in")
    reduces = tuple(job.ReduceTask("weftflow.channels", (f"{folder}/keys-{k}", f"{folder}/counts-{k}")) for k in range(2))
    job.run(spark, job.Job((job.MapTask("weftflow.words", f"{folder}/in"),), reduces))
    found = [spark.read.schema("value string").text([f"{folder}/{name}-{k}" for k in range(2)]).select(F.lit(c).alias("channel"), "value") for c, name in enumerate(("keys", "counts"))]
    return found[0].unionByName(found[1])


WITH_DEFAULT = registry.Registry("mapper with a default", default=WordsMapper)


@query
def registry_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a default gives it for every name that it doesn't have."""
    lines = mapping.emit(table(spark, sf_dir, "part"), F.lit(""), F.col("p_name"))
    mapped = mapping.run_mapper(lines, WITH_DEFAULT.find("nobody registered this"), mapping.Context(shards=2))
    return mapped.groupBy(F.col("key").alias("word")).agg(F.count("*").alias("n"))


class FirstReducer(reducing.BatchReducer):
    """Looks at one value of each key; the others are skipped."""

    def reduce(self, key, values):
        self.output(key, next(values))


@query
def discard_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer class that stops reading a key's values, all of which are equal here."""
    pairs = mapping.emit(table(spark, sf_dir, "part"), F.col("p_brand"), F.lower("p_brand"))
    return reducing.run_reducer(routing.with_shard(pairs, 3), FirstReducer, mapping.Context(shards=3)).select("key", "value")


@registry.mapper("weftflow.contexts")
class ContextMapper(mapping.Mapper):
    def start(self):
        c = self.context
        self.output(f"map {c.input_format} {c.output_format} {c.shards} {c.map_only}", "1")

    def map(self, key, value): ...


@registry.batch_reducer("weftflow.contexts")
class ContextReducer(reducing.BatchReducer):
    def reduce(self, key, values):
        self.output(key, f"{key}; reduce {self.context.output_format} {self.context.channels}")


@query
def job_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mappers and reducers may ask about their job."""
    return _job(spark, sf_dir, "weftflow.contexts", "weftflow.contexts", "p_brand")


class NumberedFold(SumFold):
    """Says at which place in its shard each key is finished."""

    def start(self):
        self.at = 0

    def end_reduce(self, key, state):
        self.at += 1
        self.output(key, str(self.at))


@query
def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds end in byte order of their keys, shard by shard."""
    pairs = mapping.emit(table(spark, sf_dir, "part"), F.col("p_type"), F.lit("1"))
    folded = reducing.run_reducer(routing.with_shard(pairs, 3), NumberedFold, mapping.Context(shards=3), incremental=True)
    return folded.select("shard", "key", F.col("value").cast("long").alias("nth"))


class ModelMapper(mapping.Mapper):
    """Sends each row to all shards, under a key that sorts before all others."""

    def map(self, key, value):
        self.output_to_all_shards("", f"{key} {value}")


class ModelReducer(reducing.BatchReducer):
    """Holds the model that it gets first, and applies it to the keys after it."""

    def reduce(self, key, values):
        if key == "":
            self.model = dict(value.split(" ", 1) for value in values)
        else:
            for value in values:
                self.output(key, self.model[value])


@query
def model_to_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that a mapper sends to every reducer before its keys: nations, which reducers look customers up in."""
    context = mapping.Context(shards=4)
    nations = mapping.emit(table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string"), F.col("n_name"))
    customers = mapping.emit(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    pairs = mapping.union_of(mapping.run_mapper(nations, ModelMapper, context), routing.with_shard(customers, 4).select("shard", "key", "value"))
    return reducing.run_reducer(pairs, ModelReducer, context).select("key", "value")


@query
def state_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper object serves all files of a task: lines of all files so far, after each of three files."""
    path = scratch(spark, "state")
    text.write_text(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).repartition(3), path)
    mapped = mapping.run_mapper(text.read_text(spark, path, by_file=True, tasks=1), RunningMapper, mapping.Context(map_only=True), by_file=True)
    return mapped.agg(F.count("*").alias("files"), F.max(F.col("value").cast("long")).alias("lines"))


class RunningMapper(mapping.Mapper):
    lines = 0

    def map(self, key, value):
        self.lines += 1

    def flush(self):
        self.output(self.current_file, str(self.lines))


@query
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = Counters()
    documents = count.counted(table(spark, sf_dir, "documents"), "map_input")
    mapped = count.counted(documents.select(F.explode(word_array()).alias("word")), "map_output")
    count.counted(mapped.groupBy("word").agg(F.count("*").alias("n")), "reduce_keys").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(count.values().items()), "name string, value long")


@query
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental reduction as a streaming query that ends when its input does."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_input(spark, events))
    return incremental.fold_stream(stream.select(F.col("event_type").alias("key")), scratch(spark, "state"), F.count("*").alias("n"))


def _stream_input(spark: SparkSession, df: DataFrame) -> str:
    """File streams read folders, so the table is copied into one."""
    path = scratch(spark, "stream")
    df.write.parquet(path)
    return path
