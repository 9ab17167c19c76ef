"""Dealing rows to shards: by hash, by any expression, to all, or by ranges.

A shard is a Spark partition: shard ``k`` of ``n`` is partition ``k`` after :func:`to_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shard_of


def with_shard(df: DataFrame, shards: int, key: str = "key", shard: Column | None = None) -> DataFrame:
    """A ``shard`` column: the given expression, or the key's default hash modulo the number of shards."""
    return df.withColumn("shard", shard_of(F.col(key).cast("string"), shards) if shard is None else shard.cast("int"))


def checked(df: DataFrame, shards: int) -> DataFrame:
    """``df``, which fails at run time if its ``shard`` is null or outside [0, shards)."""
    wrong = F.raise_error(F.concat(F.lit(f"shard outside [0, {shards}): "), F.coalesce(F.col("shard").cast("string"), F.lit("null"))))
    return df.withColumn("shard", F.when(F.col("shard").between(0, shards - 1), F.col("shard")).otherwise(wrong).cast("int"))


def to_all_shards(df: DataFrame, shards: int) -> DataFrame:
    """Every row once for each shard."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def to_shards(df: DataFrame, shards: int, key: str | None = "key") -> DataFrame:
    """Rows in the partition of their ``shard``, which must be in range; in byte order of ``key``, if given."""
    dealt = checked(df, shards).repartitionById(shards, F.col("shard"))
    return dealt if key is None else dealt.sortWithinPartitions(key)


def by_range(df: DataFrame, shards: int, *columns: str) -> DataFrame:
    """A total order: shards hold ascending ranges, each in order."""
    return df.repartitionByRange(shards, *columns).sortWithinPartitions(*columns)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is a scan with fewer splits than there are cores, else as it is.

    For rows that a costly step follows; large inputs have more splits than cores and aren't moved.
    """
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if plan.nodeName().startswith("Adaptive") or "Exchange" in plan.toString():  # exchanges deal rows already
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
