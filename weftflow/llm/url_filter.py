"""URL filters by a sort-merge range join (operator 8).

A host's canonical key has its labels reversed, each followed by a dot: ``example.com`` is ``com.example.``.
All hosts that a rule's host covers, itself and its subdomains, are then one interval of keys, those that
start with the rule's; and the paths that a rule covers are one interval of the sorted paths of a key. Urls and
rules are cut into the same ranges of (key, path, salt) and sorted; a rule goes to every range that its interval
meets. In a range one sweep walks runs of urls with one key and keeps a stack of the hosts whose intervals are
open, nested by construction. The rules of each open host, from the outermost inwards, then take their intervals
of the run's paths in path order, so that of nested intervals the inner one, of the longer path, is left on top.

Ranges come from a bounded sample of keys, which decides only where ranges end. The salt spreads a url that
very many pages share, and the path a host that they share, so no range is forced to be large. Runs are handled
in batches: Python steps are taken for runs and rules, not for urls.

Of the rules that fit, the one with the longest host wins, then the longest path, then block over allow.

Edge cases: a null url or one without ``://`` has empty host and path, which no rule fits; ids may be of any type;
null ids and repeated rows are kept; urls of any length are read whole; an empty host in a rule covers
nothing; other columns are left out, so their names can't clash; with no rules every url gets the default
verdict; no urls give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
#: Keys in the sample that sets the ranges, for each range.
SAMPLED = 20
_TOP = "\U0010ffff"
#: Between the parts of a place (numpy drops a NUL at the end of a string).
_CUT = "\x01"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    reversed_labels = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.when(host == "", F.lit("")).otherwise(F.concat(reversed_labels, F.lit(".")))


class OpenHost:
    """The rules of one host whose interval the sweep is in, by path."""

    def __init__(self, key: str):
        self.key, self.rules, self.paths, self.sizes = key, {}, [], set()

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.rules.get(path, ("", ""))[1] != "block":
            self.rules[path] = (rule, verdict)
        self.paths = []

    def take(self, paths: np.ndarray, rules: list, hits: np.ndarray) -> None:
        """Put this host's rules on their intervals of sorted ``paths``, numbered as they enter ``rules``."""
        if not self.paths:
            self.paths, self.sizes = sorted(self.rules), sorted({len(path) for path in self.rules})
        first = paths[0]
        begun = [first[:size] for size in self.sizes if size < len(first) and first[:size] in self.rules]
        for path in begun + self.paths[bisect_left(self.paths, first) : bisect_right(self.paths, paths[-1])]:
            start = bisect_left(paths, path)
            end = bisect_left(paths, True, start, key=lambda p: not p.startswith(path))
            if start < end:
                hits[start:end] = len(rules)
                rules.append(self.rules[path])


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge the urls of one range, from rows in order of key, rules before urls, and path."""
    open_hosts: list[OpenHost] = []  # each inside the one before
    for batch in batches:
        keys, is_url, paths, names, verdicts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "is_url", "path", "rule", "verdict"))
        hits = np.full(len(keys), -1)
        rules: list[tuple[str, str]] = []
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (is_url[1:] != is_url[:-1])) + 1
        edges = [0, *cuts.tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:]):
            key = keys[a]
            while open_hosts and not key.startswith(open_hosts[-1].key):
                open_hosts.pop()
            if is_url[a]:
                for host in open_hosts:
                    host.take(paths[a:b], rules, hits[a:b])
                continue
            if not open_hosts or open_hosts[-1].key != key:
                open_hosts.append(OpenHost(key))
            for k in range(a, b):
                open_hosts[-1].add(paths[k], names[k], verdicts[k])
        urls = pa.array(is_url)
        hits = pa.array(hits[is_url.astype(bool)])
        taken = pa.array(np.where(hits.to_numpy() < 0, len(rules), hits.to_numpy()))
        judged = [pa.array([*(r[k] for r in rules), default], pa.string()).take(taken) for k, default in ((0, None), (1, DEFAULT))]
        yield pa.record_batch([batch.column(c).filter(urls) for c in ("page_id", "host", "path")] + judged, names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, ranges: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; a rule's name is its host and path joined.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pages.schema[id_col].dataType
    none = F.lit(None).cast("string")
    # deals pages of one url to ranges
    salt = F.lpad(F.hex(F.xxhash64(id_col)), 16, "0").alias("salt")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), salt)
    urls = urls.select(F.lit(0).alias("range"), key_of(F.col("host")).alias("key"), F.lit(True).alias("is_url"), "path", "page_id", "host", none.alias("rule"), none.alias("verdict"), "salt")
    host = F.translate("host", _UPPER, _UPPER.lower())
    named = rules.where("host is not null and host <> '' and path is not null").select(
        F.lit(0).alias("range"), key_of(host).alias("key"), F.lit(False).alias("is_url"), "path", F.lit(None).cast(kind).alias("page_id"), none.alias("host"), F.concat(host, "path").alias("rule"), "verdict", F.lit("").alias("salt")
    )

    share = min(1.0, 2 * SAMPLED * ranges / max(1, urls.count()))
    sample = urls.sample(share, seed=1).select("key", "path", "salt").limit(4 * SAMPLED * ranges).collect()
    # a place is one string; any order serves in which a rule's interval holds the urls that start with its key
    places = sorted(_CUT.join(r) for r in sample)
    bounds = sorted({places[len(places) * k // ranges] for k in range(1, ranges)} if places else [])
    marks = np.array(bounds, dtype=object)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, salts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "path", "salt"))
            is_url = batch.column("is_url").to_numpy(zero_copy_only=False).astype(bool)
            row, to = [np.flatnonzero(is_url)], [np.searchsorted(marks, (keys + _CUT + paths + _CUT + salts)[is_url], side="right")]
            for k in np.flatnonzero(~is_url).tolist():  # from the range that holds the interval's start to that of its end
                low, high = bisect_left(bounds, keys[k]), bisect_right(bounds, keys[k] + _TOP)
                row.append(np.full(high - low + 1, k))
                to.append(np.arange(low, high + 1))
            out = batch.take(pa.array(np.concatenate(row)))
            yield out.set_column(0, batch.schema.field(0), pa.array(np.concatenate(to).astype(np.int32)))

    fields = f"range int, key string, is_url boolean, path string, page_id {kind.simpleString()}, host string, rule string, verdict string, salt string"
    placed = urls.unionByName(named).mapInArrow(place, fields)
    ordered = placed.drop("salt").repartitionById(ranges, F.col("range")).sortWithinPartitions("key", "is_url", "path")
    return ordered.mapInArrow(sweep, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS nth
    FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""
