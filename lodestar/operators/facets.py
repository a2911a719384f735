"""Flat and hierarchical facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$ROOT$"


@dataclass(frozen=True)
class FacetRequest:
    name: str
    path: tuple[str, ...] = ()
    limit: int | None = 10


@dataclass(frozen=True)
class FacetResult:
    """values: rows (label, n), most first, then by label. child_count counts all labels, the ones of
    documents that end at the path included; total_count sums the values returned."""

    values: list[Row]
    child_count: int
    total_count: int


def paths_of(df: DataFrame, name: str) -> DataFrame:
    """One row ``path`` (array of labels) for each facet value; strings are paths of one label."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        return df.select(F.explode(name).alias("path"))
    one = df.select(F.explode(name).alias("v")) if isinstance(kind, T.ArrayType) else df.select(F.col(name).alias("v"))
    return one.where("v IS NOT NULL").select(F.array(F.col("v").cast("string")).alias("path"))


def labels(df: DataFrame, name: str, path: tuple[str, ...] = ()) -> DataFrame:
    """(label, n) of the level below ``path``; $ROOT$ stands for values that end there."""
    rows = paths_of(df, name)
    kind = df.schema[name].dataType
    if path:
        rows = rows.where(F.slice("path", 1, len(path)) == F.array(*map(F.lit, path)))
    elif not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)):
        rows = rows.where(F.size("path") > 0)
    label = F.coalesce(F.try_element_at("path", F.lit(len(path) + 1)), F.lit(ROOT))
    return rows.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def top(df: DataFrame, name: str, path: tuple[str, ...] = (), limit: int | None = 10) -> DataFrame:
    out = labels(df, name, path).where(F.col("label") != ROOT).orderBy(F.desc("n"), "label")
    return out if limit is None else out.limit(limit)


def totals(df: DataFrame, name: str, path: tuple[str, ...] = (), limit: int | None = 10) -> DataFrame:
    """One row: child_count, total_count."""
    counted = labels(df, name, path)
    shown = counted.where(F.col("label") != ROOT).orderBy(F.desc("n"), "label")
    shown = shown if limit is None else shown.limit(limit)
    total = shown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"))
    return counted.agg(F.count("*").alias("child_count")).join(F.broadcast(total))  # one row each


def compute(df: DataFrame, request: FacetRequest) -> FacetResult:
    counted = labels(df, request.name, request.path).cache()
    shown = counted.where(F.col("label") != ROOT).orderBy(F.desc("n"), "label")
    values = (shown if request.limit is None else shown.limit(request.limit)).collect()  # as many as were asked for
    out = FacetResult(values, counted.count(), sum(r["n"] for r in values))
    counted.unpersist()
    return out
