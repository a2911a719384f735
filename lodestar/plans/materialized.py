"""Tables derived from a collection, kept up to date key by key after each commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import Collection


@dataclass
class Materialized:
    """``derive`` turns rows into derived rows, grouped by ``scope`` (an expression over the rows, named in both).

    After a commit, the scopes of the changed rows as they were and as they are now are derived anew;
    the others' rows stay. Nothing is collected: scopes travel as a DataFrame.
    """

    source: Collection
    scope: str
    expression: Column
    derive: Callable[[DataFrame], DataFrame]
    rows: DataFrame | None = None

    def __post_init__(self) -> None:
        self.rebuild()
        self.source.listeners.append(self._follow)

    def _scoped(self, df: DataFrame) -> DataFrame:
        return self.source.model.apply(df).withColumn(self.scope, self.expression)

    def rebuild(self) -> DataFrame:
        self.rows = self.derive(self._scoped(self.source.stored))
        return self.rows

    def _follow(self, before: DataFrame, changed: DataFrame) -> None:
        key = self.source.model.key
        keys = changed.select(F.col(key).alias("_key")).distinct()
        touched = None
        for df in (before, self.source.stored):
            own = self._scoped(df).join(keys, F.col(key) == F.col("_key"), "left_semi").select(F.col(self.scope).alias("_scope"))
            touched = own if touched is None else touched.union(own)
        touched = touched.distinct()
        fresh = self.derive(self._scoped(self.source.stored).join(touched, F.col(self.scope).eqNullSafe(F.col("_scope")), "left_semi"))
        kept = self.rows.join(touched, F.col(self.scope).eqNullSafe(F.col("_scope")), "left_anti")
        self.rows = kept.unionByName(fresh)
