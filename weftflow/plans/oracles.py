"""DuckDB SQL for the registered queries: the same columns and rows, written independently of Spark."""

from __future__ import annotations

_WORDS = "list_filter(string_split(text, ' '), lambda x: x <> '')"
WORDCOUNT = f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word"


def byte_list(column: str) -> str:
    """The UTF-8 bytes of a string as signed numbers."""
    return (
        f"list_transform(list_transform(range(strlen({column})), lambda i: ('0x' || substr(hex({column}), 2 * i + 1, 2))::BIGINT), "
        "lambda b: CASE WHEN b > 127 THEN b - 256 ELSE b END)"
    )


_M = "4294967295"
_NIBBLE = "((h << 4) + c) & 4294967295"
#: seed and step of each hash; h is the state and c the next byte
_STEPS = {
    "js": ("1315423911", f"xor(h, (h << 5) + c + (h >> 2)) & {_M}"),
    "bkdr": ("0", f"(h * 131 + c) & {_M}"),
    "sdbm": ("0", f"(h * 65599 + c) & {_M}"),
    "djb": ("5381", f"(h * 33 + c) & {_M}"),
    "dek": ("strlen({s})", f"xor(xor(h << 5, h >> 27), c) & {_M}"),
    "bp": ("0", f"xor(h << 7, c) & {_M}"),
    "fnv": ("0", f"xor(((h::HUGEINT * 2166136261) % 4294967296)::BIGINT, c) & {_M}"),
    "pjw": ("0", f"xor({_NIBBLE}, (({_NIBBLE}) & 4026531840) >> 24) & 268435455"),
    "elf": ("0", f"xor({_NIBBLE}, (({_NIBBLE}) & 4026531840) >> 24) & 268435455"),
}


def hash_sql(name: str, column: str) -> str:
    """A hash of a string column as a BIGINT."""
    data = byte_list(column)
    if name in _STEPS:
        seed, step = _STEPS[name]
        return f"list_reduce({data}, lambda h, c: {step}, ({seed.format(s=column)})::BIGINT)"
    if name == "rs":  # the state is factor * 2^32 + hash
        m = "4294967296::HUGEINT"
        step = f"((s // {m}) * 378551) % {m} * {m} + ((s % {m}) * (s // {m}) + c + {m}) % {m}"
        return f"(list_reduce({data}::HUGEINT[], lambda s, c: {step}, 63689::HUGEINT * {m}) % {m})::BIGINT"
    if name == "ap":  # the state is hash * 2 + parity
        h = "(s >> 1)"
        even = f"xor({h}, xor({h} << 7, c * ({h} >> 3))) & {_M}"
        odd = f"xor({h}, ~(({h} << 11) + xor(c, {h} >> 5))) & {_M}"
        return f"(list_reduce({data}, lambda s, c: CASE WHEN s % 2 = 0 THEN (({even}) << 1) + 1 ELSE ({odd}) << 1 END, (2863311530 * 2)::BIGINT) >> 1)"
    if name == "md5_64":
        turned = " || ".join(f"substr(md5({column}), {2 * k + 1}, 2)" for k in reversed(range(8)))
        return f"('0x' || {turned})::UBIGINT::DECIMAL(20,0)"
    raise KeyError(name)


def turned(number: str, size: int) -> str:
    """The hex digits of a number's bytes, the lowest first."""
    digits = f"lpad(upper(to_hex(({number})::UBIGINT)), {2 * size}, '0')"
    return "(" + " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")"


PART_WORDS = f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.replace('text', 'p_name')}) AS word FROM part) GROUP BY word"
_SHARD = hash_sql("js", "word") + " % 4"

ORACLES: dict[str, str] = {
    "wordcount": WORDCOUNT,
    "wordcount_combiner": WORDCOUNT,
    "wordcount_incremental": WORDCOUNT,
    "wordcount_batch": WORDCOUNT,
    "wordcount_fold": WORDCOUNT,
    "bigram_count": f"""SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
        FROM (SELECT {_WORDS} AS w FROM documents)) GROUP BY bigram""",
    "map_only_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'",
    "map_only_project": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem",
    "shard_histogram_js": f"SELECT ({_SHARD})::INT AS shard, sum(n)::BIGINT AS n FROM ({WORDCOUNT}) GROUP BY 1",
    "custom_shard_range": """SELECT least(floor(o_totalprice / 50000), 7)::INT AS shard, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
        FROM orders GROUP BY 1""",
    "output_to_shard": "SELECT (o_custkey % 8)::INT AS shard, (o_custkey % 8)::INT AS partition, count(*) AS n FROM orders GROUP BY 1",
    "output_to_all_shards": "SELECT s::INT AS shard, n_nationkey, n_name FROM nation, range(3) t(s)",
    "channel_split": """SELECT (user_id % 3)::INT AS channel, event_type, count(*) AS n FROM events GROUP BY ALL""",
    "identity_reduce": "SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer",
    "distinct_keys": "SELECT DISTINCT c_mktsegment AS key FROM customer",
    "sum_by_key": "SELECT l_returnflag AS key, sum(l_quantity)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1",
    "min_max_by_key": "SELECT l_suppkey AS key, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    "avg_by_key": "SELECT l_linestatus AS key, round(sum(l_quantity::BIGINT) / count(*), 6) AS mean FROM lineitem GROUP BY 1",
    "collect_sorted_values": "SELECT o_custkey AS key, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1",
    "union_heterogeneous_mappers": """SELECT key, count(*) AS n FROM (SELECT c_nationkey::VARCHAR AS key FROM customer
        UNION ALL SELECT s_nationkey::VARCHAR FROM supplier) GROUP BY key""",
    "heterogeneous_reducers": """SELECT (o_custkey % 2)::INT AS shard, o_custkey::VARCHAR AS key,
        (CASE WHEN o_custkey % 2 = 0 THEN count(*) ELSE max(o_orderkey) END)::VARCHAR AS value FROM orders GROUP BY o_custkey""",
    "reduce_side_join": "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey",
    "reduce_side_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey",
    "reduce_side_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "reduce_side_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "reduce_side_full": """SELECT c.c_custkey AS customer, o.o_custkey AS ordered FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c
        FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON o.o_custkey = c.c_custkey""",
    "broadcast_join_all_shards": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "set_intersect": "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS key FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "topk_per_shard": """SELECT shard, nth, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT (l_suppkey % 4)::INT AS shard, l_orderkey, l_linenumber, l_extendedprice,
        row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS nth FROM lineitem) WHERE nth <= 3""",
    "range_total_order": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 0::BIGINT AS rows_out_of_order, 0::BIGINT AS shards_out_of_order FROM orders",
    "multi_pass": "SELECT n_name AS word, 3 * count(*) AS n FROM nation GROUP BY 1",
    **{f"hash_{name}": f"SELECT p_partkey, {hash_sql(name, 'p_name')} AS hash FROM part" for name in (*_STEPS, "rs", "ap", "md5_64")},
    "split_set": f"SELECT doc_id, len(list_distinct({_WORDS})) AS n, array_to_string(list_sort(list_distinct({_WORDS})), ' ') AS words FROM documents",
    "join_strings": "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS joined FROM part",
    "printf_key": "SELECT p_partkey, p_brand || '-' || printf('%010d', p_partkey) AS key FROM part",
    "int_to_key": "SELECT o_orderkey, printf('%010d', o_orderkey) AS key FROM orders",
    "key_to_int": "SELECT o_orderkey, o_orderkey AS number, o_custkey::INT AS prefix, 0 AS none FROM orders",
    "encode_decode": """SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS bytes, (-o_custkey)::INT AS number
        FROM (SELECT o_orderkey, o_custkey, upper(printf('%08x', (4294967296 - o_custkey) % 4294967296)) AS h FROM orders)""",
    "reducer_start_flush_lines": f"""SELECT s::INT AS shard, line AS value FROM range(4) r(s), (VALUES ('start'), ('flush')) v(line) UNION ALL
        SELECT ({hash_sql("js", "event_type")} % 4)::INT, event_type || ' ' || count(*) FROM events GROUP BY event_type""",
    "random_numbers": """SELECT count(*) AS n, true AS unit_in_range, true AS whole_in_range, true AS unit_centred, true AS all_wholes, true AS same_for_a_seed,
        5000 AS tick FROM part""",
    "printf_c": """SELECT p_partkey, lpad(p_size::VARCHAR, 5, '0') || '|' || (-p_size)::VARCHAR || '|' || rpad(p_partkey::VARCHAR, 12, ' ') || '|' || lower(to_hex(p_size)) || '|'
        || ((18446744073709551616::HUGEINT - p_partkey) % 18446744073709551616::HUGEINT)::VARCHAR || '|' || ((4294967296 - p_size) % 4294967296)::VARCHAR || '|' || chr((p_size + 64)::INT) || '|' || substr(p_brand, 1, 3) || '|100%' AS line FROM part""",
    "codec_types": f"""SELECT o_orderkey, {turned("(4294967296 - o_custkey) % 4294967296", 4)} AS int32_bytes, true AS int32_back,
        {turned("4294967295 - o_orderkey", 4)} AS uint32_bytes, true AS uint32_back, lpad((4294967295 - o_orderkey)::VARCHAR, 10, '0') AS uint32_key, true AS uint32_key_back,
        {turned("(18446744073709551616::HUGEINT - o_orderkey::HUGEINT * 10000000000) % 18446744073709551616::HUGEINT", 8)} AS int64_bytes, true AS int64_back,
        {turned("18446744073709551615::HUGEINT - o_orderkey", 8)} AS uint64_bytes, true AS uint64_back, (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR AS uint64_key, true AS uint64_key_back
        FROM orders""",
    "strict_lines": """SELECT CASE WHEN strlen(p_name) < 23 THEN p_name ELSE '' END AS value, sum(CASE WHEN strlen(p_name) < 23 THEN 1 ELSE (strlen(p_name) + 23) // 23 END)::BIGINT AS n
        FROM part GROUP BY 1""",
    "job_by_name": f"SELECT word || ' ' || n AS value FROM ({PART_WORDS})",
    "job_incremental": f"SELECT word || ' ' || n AS value FROM ({PART_WORDS})",
    "job_contexts": "SELECT 'map text text 3 False; reduce text 1' AS value",
    "job_own_formats": "SELECT '1' AS value FROM (SELECT unnest(list_filter(string_split(p_brand, ' '), lambda x: x <> '')) AS word FROM part)",
    "job_channels": f"SELECT 0 AS channel, word AS value FROM ({PART_WORDS}) UNION ALL SELECT 1, word || ' ' || n FROM ({PART_WORDS})",
    "registry_default": PART_WORDS,
    "discard_rest": "SELECT DISTINCT p_brand AS key, lower(p_brand) AS value FROM part",
    "key_order": f"""SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key COLLATE C) AS nth
        FROM (SELECT DISTINCT p_type AS key, ({hash_sql("js", "p_type")} % 3)::INT AS shard FROM part)""",
    "model_to_shards": "SELECT c_custkey::VARCHAR AS key, n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "state_over_files": "SELECT 3::BIGINT AS files, count(*) AS lines FROM customer",
    "text_roundtrip": "SELECT p_name AS value FROM part",
    "text_offsets": "SELECT count(*) AS n, count(*) AS keys, sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part",
    "protofile_roundtrip": "SELECT p_partkey::VARCHAR AS key, p_name AS value FROM part",
    "per_file_hooks": "SELECT 3::BIGINT AS files, count(*) AS lines FROM customer",
    "counters": f"""SELECT 'map_input' AS name, count(*) AS value FROM documents UNION ALL SELECT 'map_output', sum(len({_WORDS}))::BIGINT FROM documents
        UNION ALL SELECT 'reduce_keys', count(*) FROM ({WORDCOUNT})""",
    "stream_fold": "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1",
}
