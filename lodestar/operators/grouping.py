"""First documents of each group, and groups page by page."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle


def top_docs(df: DataFrame, group: str, key: str, docs_per_group: int = 1, group_offset: int = 0, group_limit: int | None = None, within: Sequence[Column] = (), group_sort: Column | None = None, include_total: bool = False) -> DataFrame:
    """The first rows of each group with ``group_rank`` and ``doc_rank``.

    Groups come in the order of ``group_sort`` over their first rows (without it: of the group's value).
    Ranking within groups keeps only the first rows before they are sorted by group, so a hot group
    sends few rows on from each task. ``group_rank`` counts from 1 without gaps (from the group after
    ``group_offset``); without a limit the sorted groups are written once and numbered partition by
    partition, so no task sees them all.
    """
    order = [*within, F.col(key).asc()]
    ranked = df.withColumn("doc_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("doc_rank") <= docs_per_group)
    heads = ranked.where("doc_rank = 1").orderBy(group_sort if group_sort is not None else F.col(group).asc(), F.col(group).asc())
    if group_offset:
        heads = heads.offset(group_offset)
    if group_limit is not None:
        heads = heads.limit(group_limit)
    heads = heads.select(F.col(group).alias("_group"), F.monotonically_increasing_id().alias("_at"))
    if group_limit is not None:
        places = heads.select("_group", F.row_number().over(Window.orderBy("_at")).alias("group_rank"))
    else:
        heads = settle(heads)  # the sort's partitions must not change between counting and numbering
        part = F.shiftright("_at", 33)
        counts = heads.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("_part", before.alias("_before"))  # a row a partition
        places = heads.withColumn("_part", part).join(F.broadcast(starts), "_part").select("_group", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("group_rank"))
    out = ranked.join(places, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    if include_total:
        total = df.agg(F.count_distinct(F.col(group)).alias("total_groups"))
        out = out.join(F.broadcast(total))  # one row
    return out


def composite(df: DataFrame, group: str, page_size: int, after: Any = None) -> DataFrame:
    """(key, n) of the next groups by key; ``after`` is the previous page's last key."""
    rows = df.where(F.col(group).isNotNull())
    if after is not None:
        rows = rows.where(F.col(group) > F.lit(after))
    return rows.groupBy(F.col(group).alias("key")).agg(F.count("*").alias("n")).orderBy("key").limit(page_size)
