"""Incremental reduction over a stream: an extra, beyond finite inputs.

The fold of an incremental reducer as a stateful streaming aggregation. It takes what is there, in as many
micro-batches as the source makes of it, and ends; state is checkpointed, so a restarted query goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_stream(stream: DataFrame, path: str, *aggregates: Column, key: str = "key") -> DataFrame:
    """The aggregates of each key over all that ``stream`` has held so far.

    ``path`` keeps the state and, for each micro-batch, the keys that changed in it, as files that executors
    write; the result is the last row of each key. A micro-batch that is run again replaces its own files.
    """
    folded = stream.groupBy(key).agg(*aggregates)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    query = folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not _exists(stream, f"{path}/changes"):
        return spark.createDataFrame([], folded.schema)
    changes = spark.read.schema(f"{folded.schema.toDDL()}, batch long").parquet(f"{path}/changes")
    last = F.max_by(F.struct(*folded.columns), "batch").alias("last")
    return changes.groupBy(key).agg(last).select("last.*")


def _exists(df: DataFrame, path: str) -> bool:
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)
