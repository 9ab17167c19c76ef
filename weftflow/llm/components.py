"""Connected components of a graph of long ids, by alternating large and small stars.

Each round ties every node to the smallest node it knows; a round costs four joins or aggregations on edges
alone, and the number of rounds grows with the logarithm of the components' diameter. The smallest
neighbours are written with the number of edges they meet, before they are joined back: a node with very many
edges, as the root of a large component is, is joined by broadcast of its one row (:func:`common.joined`). Every
round ends in a written table: a lost executor repeats at most one round. Nothing is gathered to the driver
but a few numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, joined


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` except the roots: the smallest node it is tied to.

    The result reads a table in the shared folder.
    """
    spark = edges.sparkSession
    tables = Tables(spark)
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = tables.write(start, "edges")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        spent, tables = tables, Tables(spark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spent.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("rows")), "least")
        large = spent.write(joined(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = spent.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), "lower")
        ties = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        small = joined(large, lower, ["u"]).select(ties.alias("t")).select("t.u", "t.v").where("u <> v").distinct()
        now = tables.write(small, "edges")
        spent.done()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge lists apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
