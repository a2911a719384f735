"""A change feed on Structured Streaming: an extension, for views that follow a log of writes.

A write log is a folder of parquet files with the rows of a collection and ``_op`` (upsert, delete) and
``_seq``. ``follow`` folds it into a table and calls ``after`` with each batch's changed keys;
``windowed`` aggregates events by time windows with a watermark for late ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(log: DataFrame, key: str) -> DataFrame:
    """The rows that a log leaves: each key's last write, deleted ones gone."""
    w = Window.partitionBy(key).orderBy(F.col("_seq").desc())
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND _op <> 'delete'").drop("_n", "_op", "_seq")


def _versions(spark: SparkSession, target: str) -> dict[int, str]:
    """The finished versions under ``target`` by batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(path(target))]
    return {int(n): f"{target}/{n}" for n in names if n.isdigit() and fs.exists(path(f"{target}/{n}/marks/_SUCCESS"))}


def follow(spark: SparkSession, log: str, schema: T.StructType, key: str, target: str, checkpoint: str, after: Callable[[DataFrame, str], None] | None = None):
    """A query that folds new log files into versions of a table under ``target``; ``after(keys, path)`` follows each.

    A version is a folder named by its batch: ``rows``, and ``marks`` with the last ``_seq`` of every key,
    deleted ones included, so a write that comes late changes nothing that is newer (of equal ``_seq`` the
    later batch holds). A restart goes on from the last finished version, a batch that is run again
    replaces its own; so ``target`` and ``checkpoint`` belong together. ``keys`` are those whose row changed.
    """

    def fold(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        w = Window.partitionBy(key).orderBy(F.col("_seq").desc())
        last = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        without = lambda old, new: old.join(new.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        done = {b: path for b, path in _versions(own, target).items() if b < n}
        before = done[max(done)] if done else None
        if before:
            marks = own.read.parquet(f"{before}/marks")
            newer = marks.select(F.col(key).alias("_k"), F.col("_seq").alias("_s"))
            last = last.join(newer, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") > F.col("_seq")), "left_anti")
        new, seen = last.where("_op <> 'delete'").drop("_op", "_seq"), last.select(key, "_seq")
        if before:
            new = without(own.read.parquet(f"{before}/rows"), last).unionByName(new)
            seen = without(marks, last).unionByName(seen)
        path = f"{target}/{n:020d}"
        new.write.mode("overwrite").parquet(f"{path}/rows")
        seen.write.mode("overwrite").parquet(f"{path}/marks")  # written last: it finishes the version
        if after is not None:
            after(last.select(key), f"{path}/rows")

    stream = spark.readStream.schema(schema).parquet(log)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates by windows of event time; events later than ``late`` are left out of a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, width), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)
