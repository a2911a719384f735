"""What reaches the driver: joins whose rows Spark underestimates aren't broadcast."""

import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import common, nearcopies, simhash


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        links = simhash.links(spark.range(100).select(F.xxhash64("id").alias("fp")))
        assert "SortMergeJoin" in plan(links) and "Broadcast" not in plan(links)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_places_of_blocks_are_not_broadcast(spark, monkeypatch):
    """32 sets in blocks of two: a set has up to 32 places."""
    monkeypatch.setattr(nearcopies, "BLOCK", 2)
    found = spark.range(32).select(F.col("id").alias("fp"), F.unhex(F.lit("00" * 80)).alias("grams"))
    left = spark.range(32).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("fp"), F.col("id").alias("comp"))
    pairs = nearcopies.in_blocks(found, left)
    text = plan(pairs)
    assert "SortMergeJoin [fp" in text


def test_tidy_returns_freed_memory(spark):
    def held():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    blocks = [np.ones(8000) for _ in range(3000)]  # 64 kB each, from the C library's heap
    last, before = blocks[-1], held()
    del blocks  # the last block keeps the heap from shrinking by itself
    common.tidy(spark)
    assert last.sum() == 8000 and held() < before - 100


EXECUTOR = """
import psutil, sys
import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lodestar.llm import common

conf = {"spark.executor.memory": "900m", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{sys.argv[1]}"}
spark = SparkSession.builder.master("local-cluster[1,1,1200]").config(map=conf).getOrCreate()

def held():
    jvm = next(p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))
    workers = {p.pid: p.memory_info().rss / 1e6 for p in jvm.children(recursive=True)}
    return jvm.memory_info().rss / 1e6, max(workers.values())

def leave(batches):
    blocks = [np.ones(8000) for _ in range(3000)]  # 64 kB each, from the C library's heap
    np.last, blocks = blocks[-1], None  # the last block keeps the heap from shrinking by itself
    yield from batches

spark.range(1).repartition(1).mapInArrow(leave, "id long").collect()
spark.range(0, 1, 1, 1).select(F.length(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3_000_000)), lambda x: F.lit("some text")), " "))).collect()
before = held()
common.tidy(spark)
after = held()
print("HELD", *before, *after)
spark.stop()
"""


def test_tidy_returns_memory_of_executors(tmp_path):
    """An executor's heap and its Python worker shrink again after a step that needed much."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": f"{here}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    ran = subprocess.run([sys.executable, "-c", EXECUTOR, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "HELD" in ran.stdout, [x for x in ran.stderr.splitlines() if "\tat " not in x][-30:]
    jvm, worker, jvm_after, worker_after = map(float, ran.stdout.split("HELD")[1].split())
    assert jvm_after < jvm - 150, (jvm, jvm_after)
    assert worker_after < worker - 100, (worker, worker_after)
