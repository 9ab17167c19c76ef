"""Benchmark decontamination by spaced-seed hashing (operator 2), in DataFrame operations only.

Texts become words: maximal runs of letters and digits, lower case. A document holds an item if in some window
of 13 aligned words (the whole item, if it has fewer) at least 80 % are equal: 13 and 10 to 12 words may have
two substitutions, 5 to 9 words one, and items of 1 to 4 words must stand there word for word.

A seed is a mask of word offsets; a position is hashed from the words that the mask keeps, so a substituted
word at an ignored offset doesn't change it. For windows of 13 words the two masks together are lossless:
whatever two words are substituted, one of the masks still hits at some offset. Shorter windows are cut into
one part more than they may have substitutions, each of them a mask.

Around every hit the windows are verified. Windows of equal words, in however many documents they stand, are
one passage, and a passage is compared once. Windows are cut into twice as many blocks as may have substitutions,
so that half of the blocks agree whatever is substituted: passages and items' windows meet by the words of each
half of the blocks, and are compared word by word (by 64-bit hashes).

Where more than ``CROWD`` windows of items meet under one such key, as those around a template that many items
share, they aren't compared one by one. Two windows agree if for some choice of left-out offsets all other words
are equal, so there passages meet windows by these, one row for all items that share them, and the passage is
compared with one of the windows. A template of many items in many documents makes neither pairs of them nor
copies of their words.

The result has one row per document: how many items it holds, the smallest of them and how well the best
window agrees. Items are counted over groups of items, each distinct set of groups once.

Seeds and keys are fixed-width hashes. They are broadcast only if they number at most ``BROADCAST_ROWS`` (they
are counted); otherwise positions pass a Bloom filter of the seeds and then an exchange, and passages an
exchange of keys. Both ways give the same rows.

Edge cases: null or empty texts hold nothing and match nothing; repeated rows and repeated items count once,
rows that repeat an id with another text are documents of their own; null ids are ids like others; texts of
any length are read whole; other columns are left out, so their names can't clash; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, bloom, joined, mark_of, without

WINDOW = 13
#: Offsets that a mask keeps in a window of 13 words (found by search: lossless for 2 substitutions).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
#: Rows that may be broadcast of seeds (8 bytes each), keys (16 to 32 bytes) and windows (150 bytes; several keys each).
BROADCAST_ROWS = 1_000_000
#: Windows of items that are compared one by one under a key.
CROWD = 16
#: Words that a window may reach over the ends of a document, where they count as unequal.
_OVER = 2
_W = [f"w{j}" for j in range(WINDOW)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def allowed(size: int) -> int:
    """Substitutions allowed in a window of so many words: at most 20 %."""
    return size // 5


def masks(size: int) -> list[tuple[int, ...]]:
    """The masks of a window of so many words."""
    if size == WINDOW:
        return list(MASKS)
    parts = allowed(size) + 1
    edges = [size * k // parts for k in range(parts + 1)]
    return [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]


def slides(size: int, mask: tuple[int, ...]) -> int:
    """How far a mask may stand from the start of its window; those of short windows have their place."""
    return WINDOW - 1 - mask[-1] if size == WINDOW else 0


def omissions(size: int) -> list[int]:
    """All choices of offsets to leave out, up to as many as are allowed, each a number with their bits."""
    return [sum(1 << x for x in left_out) for most in range(allowed(size) + 1) for left_out in combinations(range(size), most)]


def halves(size: int) -> list[int]:
    """All choices of half of the blocks to leave out, as bits; nothing where no word may be substituted."""
    spare = allowed(size)
    edges = [size * k // (2 * spare) for k in range(2 * spare + 1)] if spare else []
    blocks = [sum(1 << x for x in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(blocks, spare)]


def seeds(df: DataFrame, sizes: list[int], *carry: str) -> DataFrame:
    """A row for each position and mask: ``at``, ``seed`` (its number), ``hash``, ``h`` and the carried columns.

    ``df`` has ``h``, the hashes of a text's words.
    """
    family = [mask for size in sizes for mask in masks(size)]
    least = min(mask[-1] for mask in family) + 1
    places = F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))
    placed = df.select(*carry, "h", F.explode(places).alias("at"))
    each = []
    for k, mask in enumerate(family):
        kept = F.xxhash64(F.lit(k), *(F.get("h", F.col("at") + o) for o in mask))
        each.append(F.when(F.col("at") + mask[-1] < F.size("h"), kept))
    return placed.select(*carry, "h", "at", F.posexplode(F.array(*each)).alias("seed", "hash")).where("hash is not null")


def _pick(index: Column, values: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def _window(hashes: str, start: Column) -> list[Column]:
    """``w0`` to ``w12``: the words of a window of ``size`` words, each hashed with its offset; 0 beyond its end."""
    return [F.when(F.lit(j) < F.col("size"), F.xxhash64(F.lit(j), F.get(hashes, start + j))).otherwise(0).alias(f"w{j}") for j in range(WINDOW)]


def windows(hits: DataFrame, sizes: list[int]) -> DataFrame:
    """The distinct windows around hits: ``doc_id, mark, size`` and the hashes ``w0`` to ``w12`` of their words."""
    family = [(size, mask) for size in sizes for mask in masks(size)]
    size = _pick(F.col("seed"), [n for n, _ in family])
    slide = _pick(F.col("seed"), [slides(n, mask) for n, mask in family])
    first = F.greatest(F.col("at") - slide, F.lit(0))
    slid = (F.col("at") - first).alias("slid")
    near = hits.select("doc_id", "mark", slid, size.alias("size"), F.slice("h", first + 1, F.col("at") - first + size).alias("near"))
    starts = F.explode(F.sequence(F.lit(0), F.least(F.col("slid"), F.size("near") - F.col("size"))))
    placed = near.where("size(near) >= size").select("doc_id", "mark", "size", "near", starts.alias("k"))
    return placed.select("doc_id", "mark", "size", *_window("near", F.col("k"))).distinct()


def keyed(df: DataFrame, codes: dict[int, list[int]], *carry: str) -> DataFrame:
    """A row for each choice of left-out offsets that ``codes`` has for a window's size: ``size``, ``left_out``
    (how many), ``key``, ``w`` (all words' hashes) and the carried columns."""
    of = F.lit(None).cast("array<int>")
    for size, some in codes.items():
        of = F.when(F.col("size") == size, F.array(*map(F.lit, some))).otherwise(of)
    each = df.select(*carry, "size", *_W, F.explode(of).alias("code"))
    rest = F.lit(0).cast("long")
    for j, w in enumerate(_W):
        rest = rest.bitwiseXOR(F.when(F.col("code").bitwiseAND(1 << j) == 0, F.col(w)).otherwise(0))
    return each.select(*carry, "size", F.array(*_W).alias("w"), F.bit_count("code").alias("left_out"), F.xxhash64("size", "code", rest).alias("key"))


def _two(*of: Column | str) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(F.lit(17), *of), F.xxhash64(*of, F.lit(71))]


def set_of(*of: Column | str) -> list[Column]:
    """Aggregates that tell sets of distinct rows apart: two hashes and the number of elements."""
    one, two = _two(*of)
    return [F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"), F.count("*").alias("n")]


class Benchmark:
    """The items' seeds, windows, keys and groups, as written tables."""

    #: Sizes of windows that items have.
    sizes: list[int]

    def __init__(self, benchmark: DataFrame, tables: Tables, item_col: str = "item_id", item_text: str = "text"):
        items = benchmark.select(F.col(item_col).alias("item_id"), F.transform(words(F.col(item_text)), lambda w: F.xxhash64(w)).alias("h")).where("size(h) > 0")
        length = F.least(F.size("h"), F.lit(WINDOW))
        items = tables.write(items.distinct().withColumn("size", length), "benchmark-words")
        self.sizes = sorted(r.size for r in items.select("size").distinct().collect())
        if not self.sizes:
            return
        own = F.lit(False)
        for k, size in enumerate(size for size in self.sizes for _ in masks(size)):
            # an item has only the seeds of its own size, a short one only those at its start
            own = own | ((F.col("seed") == k) & (F.col("size") == size) & (F.lit(size == WINDOW) | (F.col("at") == 0)))
        self.seeds = tables.write(seeds(items, self.sizes, "size").where(own).select("hash").distinct(), "benchmark-seeds", read_by_result=True)
        placed = items.select("item_id", "h", "size", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("size"))).alias("at"))
        placed = placed.select("item_id", "size", *_window("h", F.col("at")))
        placed = tables.write(placed.withColumn("window", F.xxhash64("size", *_W)), "benchmark-windows", read_by_result=True)
        #: The distinct windows by number, with their words and the group of items that have them.
        self.windows = tables.write(_grouped(placed, "window").join(placed.groupBy("window").agg(F.first("size").alias("size"), *(F.first(w).alias(w) for w in _W)), "window"), "benchmark-window-groups", read_by_result=True)
        coarse = tables.write(keyed(self.windows, self.halves, "window").select("key", "window"), "benchmark-halves", read_by_result=True)
        crowded = coarse.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWD)
        found = _members(placed, "window", self.windows)
        #: Keys of half of the blocks (key, window), but those under which too many windows meet.
        self.coarse = coarse
        #: The keys left out, and those of all agreements (key, window, items, item_id) for the windows under them.
        self.crowded = self.keys = None
        if not crowded.isEmpty():
            self.crowded = tables.write(crowded, "benchmark-crowded", read_by_result=True)
            self.coarse = tables.write(joined(coarse, self.crowded, ["key"], "left_anti"), "benchmark-few", read_by_result=True)
            many = joined(coarse, self.crowded, ["key"], "left_semi").select("window").distinct()
            keys = tables.write(keyed(placed.join(many, "window"), self.omissions, "item_id", "window").select("key", "item_id", "window").distinct(), "benchmark-keys", read_by_result=True)
            windows_of = keys.groupBy("key").agg(F.min("window").alias("window"))
            self.keys = tables.write(_grouped(keys, "key").join(windows_of, "key"), "benchmark-key-groups", read_by_result=True)
            found = found.unionByName(_members(keys, "key", self.keys)).distinct()
        #: Which items (``item_id``) each group (``items``) stands for.
        self.members = found

    @property
    def halves(self) -> dict[int, list[int]]:
        return {size: halves(size) for size in self.sizes}

    @property
    def omissions(self) -> dict[int, list[int]]:
        return {size: omissions(size) for size in self.sizes}


def _grouped(df: DataFrame, key: str) -> DataFrame:
    """``key``, the group of its items (``items``) and the smallest of them."""
    sets = df.select(key, "item_id").distinct().groupBy(key).agg(*set_of("item_id"), F.min("item_id").alias("item_id"))
    return sets.select(key, F.xxhash64("one", "two", "n").alias("items"), "item_id")


def _members(df: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """``items, item_id``, from one key of each group."""
    firsts = groups.groupBy("items").agg(F.min(key).alias(key))
    return firsts.join(df.select(key, "item_id").distinct(), key).select("items", "item_id")


def _maybe_broadcast(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """A written table, broadcast if it has few enough rows; its columns are of fixed width."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def compared(met: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """Passages that agree with the ``window`` they met, word by word: ``p, q, rows, size, matched, items, item_id``."""
    own = windows.drop("size").withColumn("iw", F.array(*_W)).drop(*_W)
    both = met.join(F.broadcast(own) if windows.count() <= broadcast_rows // 8 else own, "window")
    equal = F.aggregate(F.zip_with("w", "iw", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    both = both.select("p", "q", "rows", "size", "items", "item_id", (equal - (F.lit(WINDOW) - F.col("size"))).alias("matched"))
    return both.where(F.col("matched") >= F.col("size") - F.floor(F.col("size") / 5))


def held(documents: DataFrame, benchmark: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """:func:`contaminated` with the ``mark`` of the text; None where there is no item."""
    b = Benchmark(benchmark, tables, item_col, item_text)
    if not b.sizes:
        return None
    over = F.array_repeat(F.lit(0).cast("long"), _OVER)
    text = F.col(text_col)
    read = documents.select(F.col(id_col).alias("doc_id"), mark_of(text).alias("mark"), F.concat(over, F.transform(words(text), lambda w: F.xxhash64(w)), over).alias("h"))
    found = seeds(read, b.sizes, "doc_id", "mark")
    if b.seeds.count() <= broadcast_rows:
        hits = found.join(F.broadcast(b.seeds), "hash", "left_semi")
    else:
        hits = found.where(bloom(b.seeds, "hash", b.seeds.count())(F.col("hash")))
        near = F.greatest(F.col("at") - WINDOW, F.lit(0))
        # words near the hit, not the text, go through the exchange
        hits = hits.select("doc_id", "mark", "seed", "hash", (F.col("at") - near).alias("at"), F.slice("h", near + 1, 3 * WINDOW).alias("h"))
        hits = hits.join(b.seeds, "hash", "left_semi")
    placed = windows(hits, b.sizes)
    hashes = ["size", *_W]
    p, q = _two(*hashes)
    placed = tables.write(placed.select("doc_id", "mark", p.alias("p"), q.alias("q"), *hashes), "passages-in-documents", read_by_result=True)
    passages = placed.groupBy("p", "q").agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in hashes))
    halved = keyed(passages, b.halves, "p", "q", "rows")
    agree = compared(halved.join(_maybe_broadcast(b.coarse, broadcast_rows), "key"), b.windows, broadcast_rows)
    if b.keys is not None:
        crowded = halved.join(_maybe_broadcast(b.crowded.select("key"), broadcast_rows), "key", "left_semi").select("p", "q").distinct()
        met = keyed(passages.join(crowded, ["p", "q"]), b.omissions, "p", "q", "rows").join(_maybe_broadcast(b.keys, broadcast_rows), "key")
        agree = agree.unionByName(compared(met, b.windows.drop("items", "item_id"), broadcast_rows))
    best = F.max(F.struct("matched", "size")).alias("best")
    # a passage has at most 6 * CROWD windows and 92 keys, so at most as many groups of items
    verified = agree.groupBy("p", "q").agg(F.max("rows").alias("rows"), best, F.min("item_id").alias("item_id"), F.array_sort(F.collect_set("items")).alias("groups"))
    one, two = _two("groups")
    verified = tables.write(verified.withColumns({"g1": one, "g2": two}), "passages", read_by_result=True)
    # per document: its best window, its smallest item, and which sets of groups it has
    in_docs = joined(placed.select("doc_id", "mark", "p", "q"), verified.drop("groups"), ["p", "q"])
    sets = in_docs.groupBy("doc_id", "mark", "g1", "g2").agg(F.max("best").alias("best"), F.min("item_id").alias("item_id"))
    docs = sets.groupBy("doc_id", "mark").agg(F.max("best").alias("best"), F.min("item_id").alias("item_id"), *set_of("g1", "g2"))
    docs = tables.write(docs.withColumn("of", F.xxhash64("one", "two", "n")).drop("one", "two", "n"), "documents-with-items", read_by_result=True)
    counts = tables.write(_counts(docs, placed, verified, b.members), "item-counts", read_by_result=True)
    out = joined(docs, counts, ["of"])
    return out.select("doc_id", "mark", "item_id", F.col("items").alias("n_items"), F.col("best.matched").cast("long").alias("matched"), F.col("best.size").cast("long").alias("window"))


def _counts(docs: DataFrame, placed: DataFrame, verified: DataFrame, members: DataFrame) -> DataFrame:
    """``of``, how many ``rows`` of ``docs`` have it, and how many ``items`` they hold each: counted in one of them."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    firsts = docs.groupBy("of").agg(least.alias("first"), F.count("*").alias("rows")).select("of", "rows", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("mark"))
    windows_of = placed.join(firsts, (placed["mark"] == firsts["mark"]) & placed["doc_id"].eqNullSafe(firsts["first_id"])).select("of", "rows", "p", "q").distinct()
    groups = windows_of.join(verified.select("p", "q", "groups"), ["p", "q"]).select("of", "rows", F.explode("groups").alias("items")).distinct()
    return groups.join(members, "items").select("of", "rows", "item_id").distinct().groupBy("of", "rows").agg(F.count("*").alias("items"))


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document that holds an item: ``doc_id``, the smallest ``item_id``, ``n_items``, and the
    ``matched`` words of the best ``window`` (of those, the longest)."""
    out = held(documents, benchmark, Tables(documents.sparkSession), id_col, text_col, item_col, item_text, broadcast_rows)
    if out is None:
        item = F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id")
        out = documents.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("mark"), item, *(F.lit(0).cast("long").alias(c) for c in ("n_items", "matched", "window"))).limit(0)
    return out.drop("mark")


def members(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``items, item_id``: the groups of items that share a passage, as :func:`contaminated` counts them."""
    b = Benchmark(benchmark, Tables(benchmark.sparkSession), item_col, item_text)
    return b.members if b.sizes else benchmark.select(F.lit(0).cast("long").alias("items"), F.col(item_col).alias("item_id")).limit(0)


def keep(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no item, with all their columns."""
    tables, own = Tables(documents.sparkSession), Tables(documents.sparkSession)
    bad = held(documents, benchmark, own, id_col, text_col)
    if bad is None:
        return documents
    listed = tables.write(bad.select("doc_id", "mark", F.lit(False).alias("stays"), F.lit(1).alias("rows")), "contaminated")
    rows = without(documents, listed, tables, id_col, text_col)
    own.done(everything=True)
    tables.done()
    return rows


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT item_id, len(w) AS length, least(len(w), 13) AS win FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM b SEMI JOIN n USING (item_id)),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT DISTINCT doc_id, item_id, p - q AS diagonal, q FROM dw JOIN bw USING (word)),
c AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS k FROM m),
f AS (SELECT doc_id, item_id, max(k) AS matched, any_value(win) AS win FROM c JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING max(k) >= any_value(win) - any_value(win) // 5)
SELECT doc_id, min(item_id) AS item_id, count(*) AS n_items, max(matched)::BIGINT AS matched, arg_max(win, matched * 100 + win)::BIGINT AS "window" FROM f GROUP BY doc_id
"""
