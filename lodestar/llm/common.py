"""Helpers that the training-data operators share: tables, shared storage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go through Python at a time, so that memory doesn't follow Arrow's batch size.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and Spark runs in one process (tests), a folder of this machine is used; on a
    cluster an unset folder is an error, as a local one would be lost with its executor.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


#: Folders made by this process, for :func:`release`.
_MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/lodestar/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> None:
    """Delete all tables and files that operators of this process left in the shared folder.

    Results are read from them until they are written elsewhere, so this is for the caller to decide.
    """
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/lodestar/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give what this Python process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    trim()
    yield from ()


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the shuffle files of finished steps only after that.

    For operators of many steps, whose files would else add up until the driver happens to collect. What
    the C library keeps of freed memory, in Python and in the JVM, goes back to the system, where both can.
    Executors collect too, in a task for each core: their heaps otherwise keep the size that the largest
    step so far has grown them to, beside the Python workers of all later ones.
    """
    trim()
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):
        jvm = spark._jvm
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(command, "systemTrimNativeHeap", None, None)
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc') AS done").mapInArrow(_trimmed, "done string").collect()


def open_shared(path: str, mode: str):
    """Open a file of the shared folder on any machine; file: needs a mounted path, other schemes pyarrow."""
    if path.startswith(("file:", "/")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    if "w" in mode:
        store.create_dir(os.path.dirname(inside), recursive=True)
        return store.open_output_stream(inside, compression=None)
    return store.open_input_file(inside)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch between Spark and Python, where the session doesn't say.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Have batches of texts hold a few megabytes: the default of 10,000 rows makes buffers of tens, for each task and outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text (null: empty); other columns play no part, whatever their names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def pieces_of(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Components of a graph of longs (columns u, v) as (node, comp): comp is the smallest node reached.

    Alternating large-star and small-star steps: each node's neighbours are re-hung under the smallest
    of them. Minima are aggregated before the shuffle and joined back, so a hub's edges are split by
    adaptive execution and no adjacency list is built. Every round is written to the shared folder.
    Empty edges give an empty result. The rounds grow with the logarithm of a component's diameter; if
    ``rounds`` don't settle it, RuntimeError is raised rather than a part returned.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stored(small, "cc")
        same = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
