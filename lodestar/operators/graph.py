"""Graphs as edge tables (_from, _to, ...): traversal, paths, components.

Every traversal goes level by level: a frontier is joined with the edges and what was seen before is
taken out, each level a plan over DataFrames. Levels are written to the checkpoint folder so that the
plan doesn't grow; ``max_depth`` bounds them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Levels after which what was seen is written as one table.
LEVELS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in one process (tests) a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The rows, their lineage cut, in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def edge_id(source: Column, target: Column, extra: Column | None = None) -> Column:
    return F.concat_ws("-", source, target, *([] if extra is None else [extra]))


def reverse(edges: DataFrame) -> DataFrame:
    """Edges the other way round; a projection, nothing is stored."""
    return edges.withColumns({"_from": F.col("_to"), "_to": F.col("_from")})


def edges_for(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("_from") == F.lit(node))


def _seeds(spark: SparkSession, seeds: Sequence | DataFrame, edges: DataFrame) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    kind = edges.schema["_from"].dataType.simpleString()
    return spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], f"node {kind}")


def bfs(edges: DataFrame, seeds: Sequence | DataFrame, max_depth: int | None = None, where: Column | None = None) -> DataFrame:
    """(node, depth): every node reached, seeds at depth 0, by the fewest edges."""
    edges = edges.where(where) if where is not None else edges
    step = edges.select(F.col("_from"), F.col("_to")).distinct()
    seen = settle(_seeds(edges.sparkSession, seeds, edges).withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    levels = [seen]  # each written once
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = settle(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.union(frontier)
        if len(levels) % LEVELS == 0:  # else the plan grows with the depth
            seen = settle(seen)
    return seen


def traverse(edges: DataFrame, seeds: Sequence | DataFrame, max_depth: int | None = None, where: Column | None = None) -> DataFrame:
    """The edges passed on the way from the seeds, with the depth (from 1) at which they are; breadth or depth first alike."""
    own = edges.where(where) if where is not None else edges
    inner = None if max_depth is None else max_depth - 1
    nodes = bfs(own, seeds, inner)
    return own.join(nodes, F.col("_from") == F.col("node")).withColumn("depth", F.col("depth") + 1).drop("node")


def reachable(edges: DataFrame, seed) -> DataFrame:
    """All edges that leave a node that can be reached."""
    return traverse(edges, [seed]).drop("depth")


def target_ids(edges: DataFrame, seeds: Sequence | DataFrame, max_depth: int | None = None) -> DataFrame:
    """Seeds and every node reached."""
    return bfs(edges, seeds, max_depth).select(F.col("node").alias("_id"))


def documents(edges: DataFrame, seeds: Sequence | DataFrame, docs: DataFrame, max_depth: int | None = None, key: str = "_id") -> DataFrame:
    ids = target_ids(edges, seeds, max_depth).withColumnRenamed("_id", "_node")
    return docs.join(ids, F.col(key) == F.col("_node"), "left_semi")


def follow(start: DataFrame, *hops: DataFrame) -> DataFrame:
    """Nodes at the end of one edge of each table, in turn: a walk over different kinds of edges."""
    nodes = start.select(F.col(start.columns[0]).alias("node")).distinct()
    for edges in hops:
        nodes = nodes.join(edges, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
    return nodes


def all_paths(edges: DataFrame, source, target, max_depth: int) -> DataFrame:
    """(path, length): every path without a repeated node from source to target, by nodes, at most max_depth edges."""
    spark, step = edges.sparkSession, edges.select("_from", "_to").distinct()
    kind = edges.schema["_from"].dataType.simpleString()
    # only nodes from which the target is within reach are walked
    near = bfs(reverse(step), [target], max_depth).select(F.col("node").alias("_near"), F.col("depth").alias("_left"))
    useful = settle(step.join(near, F.col("_to") == F.col("_near")).select("_from", "_to", "_left"))
    now = spark.createDataFrame([([source],)], f"path array<{kind}>")
    done = spark.createDataFrame([], f"path array<{kind}>, length int")
    for depth in range(1, max_depth + 1):
        last = F.element_at("path", -1)
        now = now.join(useful, last == F.col("_from")).where(~F.array_contains("path", F.col("_to")) & (F.col("_left") + depth <= max_depth)).select(F.concat("path", F.array("_to")).alias("path"))
        now = settle(now)
        if now.isEmpty():
            break
        done = done.union(now.where(F.element_at("path", -1) == F.lit(target)).withColumn("length", F.lit(depth)))
        now = now.where(F.element_at("path", -1) != F.lit(target))
    return done


def shortest_paths(edges: DataFrame, source, target, max_depth: int | None = None) -> DataFrame:
    """(path, length): all paths of the fewest edges; the search ends when nothing new is reached, or at ``max_depth``."""
    step = edges.select("_from", "_to").distinct()
    out = bfs(step, [source], max_depth)
    found = out.where(F.col("node") == F.lit(target)).first()
    kind = edges.schema["_from"].dataType.simpleString()
    empty = edges.sparkSession.createDataFrame([], f"path array<{kind}>, length int")
    if found is None:
        return empty
    length = found["depth"]
    if length == 0:
        return edges.sparkSession.createDataFrame([([source], 0)], f"path array<{kind}>, length int")
    # edges on shortest paths go one level down towards the target
    a, b = out.select(F.col("node").alias("_a"), F.col("depth").alias("_da")), out.select(F.col("node").alias("_b"), F.col("depth").alias("_db"))
    down = settle(step.join(a, F.col("_from") == F.col("_a")).join(b, F.col("_to") == F.col("_b")).where(F.col("_db") == F.col("_da") + 1).where(F.col("_db") <= length).select("_from", "_to"))
    now = edges.sparkSession.createDataFrame([([target],)], f"path array<{kind}>")
    for _ in range(length):
        now = settle(now.join(down, F.element_at("path", 1) == F.col("_to")).select(F.concat(F.array("_from"), F.col("path")).alias("path")))
    return now.withColumn("length", F.lit(length))


def collect_reachable(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """Seeds and everything a step function (nodes to nodes) leads to."""
    name = seeds.columns[0]
    seen = settle(seeds.select(name).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = step(frontier)
        frontier = settle(found.select(F.col(found.columns[0]).alias(name)).distinct().join(seen, name, "left_anti"))
        if frontier.isEmpty():
            break
        seen = settle(seen.union(frontier))
    return seen


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of each undirected component.

    Large-star and small-star steps in turn; minima are aggregated before the shuffle, so hubs cost one
    row a task, and the number of rounds follows the logarithm of a component's size.
    """
    now = settle(edges.select(F.greatest("_from", "_to").alias("u"), F.least("_from", "_to").alias("v")).where("u <> v").distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = settle(small)
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    found = after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        nodes = edges.select(F.col("_from").alias("node")).union(edges.select("_to"))
    every = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
