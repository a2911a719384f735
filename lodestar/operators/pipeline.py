"""Stage pipelines over DataFrames: match, project, unwind, group, look up, hop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


@dataclass(frozen=True)
class Accumulator:
    """A fold: zero, add(state, value), result(state); expressions over the collected values of a column.

    Prefer ``Pipeline.group_by`` with built-in aggregates, which are combined before the shuffle; this is
    for folds they can't express, whose groups must fit a task.
    """

    value: Column
    zero: Column
    add: Callable[[Column, Column], Column]
    result: Callable[[Column], Column] = lambda s: s

    def column(self) -> Column:
        return F.aggregate(F.sort_array(F.collect_list(self.value)), self.zero, self.add, self.result)


def _agg(a: Column | Accumulator) -> Column:
    return a.column() if isinstance(a, Accumulator) else a


@dataclass(frozen=True)
class Pipeline:
    df: DataFrame

    def match(self, condition: Column) -> Pipeline:
        return Pipeline(self.df.where(condition))

    def project(self, *columns: Column | str) -> Pipeline:
        return Pipeline(self.df.select(*columns))

    map = project

    def unwind(self, array: str | Column, name: str) -> Pipeline:
        return Pipeline(self.df.withColumn(name, F.explode(array)))

    def skip(self, n: int) -> Pipeline:
        return Pipeline(self.df.offset(n))

    def limit(self, n: int) -> Pipeline:
        return Pipeline(self.df.limit(n))

    def sort_by(self, *order: Column | str) -> Pipeline:
        return Pipeline(self.df.orderBy(*order))

    def sort_page(self, *order: Column | str, offset: int = 0, limit: int = 1000) -> Pipeline:
        """One page of the sorted rows; a bounded heap in each task."""
        return Pipeline(self.df.orderBy(*order).offset(offset).limit(limit))

    def group_by(self, keys: Sequence[str | Column], **aggregates: Column | Accumulator) -> Pipeline:
        return Pipeline(self.df.groupBy(*keys).agg(*[_agg(a).alias(n) for n, a in aggregates.items()]))

    def reduce(self, **aggregates: Column | Accumulator) -> Pipeline:
        return Pipeline(self.df.agg(*[_agg(a).alias(n) for n, a in aggregates.items()]))

    def count(self) -> Pipeline:
        return Pipeline(self.df.agg(F.count("*").alias("count")))

    def facet2(self, a: Callable[[Pipeline], Pipeline], b: Callable[[Pipeline], Pipeline], names: tuple[str, str] = ("first", "second")) -> Pipeline:
        """Two branches over one input as one row of two lists."""
        lists = []
        for branch, name in zip((a, b), names, strict=True):
            out = branch(self).df
            lists.append(out.agg(F.sort_array(F.collect_list(F.struct(*out.columns))).alias(name)))
        return Pipeline(lists[0].join(F.broadcast(lists[1])))  # one row each

    def facet_top(self, key: str | Column, n: int) -> Pipeline:
        return Pipeline(self.df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(n))

    # joins

    def lookup(self, other: DataFrame, local: str, foreign: str = "_id", name: str = "found") -> Pipeline:
        """The other table's row with a key, as a struct; null where there is none."""
        right = other.select(F.col(foreign).alias("_key"), F.struct(*other.columns).alias(name))
        return Pipeline(self.df.join(right, F.col(local) == F.col("_key"), "left").drop("_key"))

    def lookup_one(self, other: DataFrame, local: str, foreign: str = "_id", name: str = "found") -> Pipeline:
        """As :meth:`lookup`, rows without a partner left out."""
        out = self.lookup(other, local, foreign, name).df
        return Pipeline(out.where(F.col(name).isNotNull()))

    def lookup_many(self, other: DataFrame, local: str, foreign: str, name: str = "found") -> Pipeline:
        """All the other table's rows with a foreign key, as a sorted list."""
        lists = other.groupBy(F.col(foreign).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*other.columns))).alias("_list"))
        joined = self.df.join(lists, F.col(local) == F.col("_key"), "left").drop("_key")
        return Pipeline(joined.withColumn(name, F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType))).drop("_list"))

    def graph_lookup(self, edges: DataFrame, start: str, max_depth: int, name: str = "reached") -> Pipeline:
        """For each row the sorted nodes within max_depth edges of its start, the start left out.

        Frontiers are (start, node) pairs for all starts at once; one join a level.
        """
        step = edges.select("_from", "_to").distinct()
        seen = graph.settle(self.df.select(F.col(start).alias("_start")).where("_start IS NOT NULL").distinct().withColumn("_node", F.col("_start")))
        frontier = seen
        for _ in range(max_depth):
            found = frontier.join(step, F.col("_node") == F.col("_from")).select("_start", F.col("_to").alias("_node")).distinct()
            frontier = graph.settle(found.join(seen, ["_start", "_node"], "left_anti"))
            if frontier.isEmpty():
                break
            seen = graph.settle(seen.union(frontier))
        lists = seen.where("_start <> _node").groupBy("_start").agg(F.array_sort(F.collect_list("_node")).alias("_list"))
        joined = self.df.join(lists, F.col(start) == F.col("_start"), "left").drop("_start")
        return Pipeline(joined.withColumn(name, F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType))).drop("_list"))

    def hop(self, edges: DataFrame, targets: DataFrame, start: str = "_id", target_key: str = "_id", max_depth: int = 1, where: Column | None = None) -> Pipeline:
        """Documents of ``targets`` that edges lead to from the rows' ids."""
        out = graph.traverse(edges, self.df.select(F.col(start).alias("node")), max_depth, where).select(F.col("_to").alias("_hit")).distinct()
        return Pipeline(targets.join(out, F.col(target_key) == F.col("_hit"), "left_semi"))
