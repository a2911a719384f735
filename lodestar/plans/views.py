"""Views: relations run on demand or kept as tables, rebuilt whole or scope by scope."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relation import Relation


@dataclass
class Materialization:
    """``on_demand`` runs the plan each time; ``cached`` keeps a table, refreshed by hand, after ``stale_after``
    or every ``every`` seconds when read; ``triggered`` refreshes after commits to what it depends on."""

    mode: str = "on_demand"
    every: float | None = None
    stale_after: float | None = None


@dataclass
class View:
    name: str
    relation: Relation
    spark: SparkSession
    folder: str | None = None
    materialization: Materialization = field(default_factory=Materialization)
    scope: str | None = None  # a column by which parts are refreshed alone
    refreshed: float = 0.0
    dirty: bool = True
    _path: str | None = None

    def plan(self) -> DataFrame:
        return self.relation.df()

    @property
    def df(self) -> DataFrame:
        m = self.materialization
        if m.mode == "on_demand":
            return self.plan()
        age = time.time() - self.refreshed
        limit = m.stale_after if m.stale_after is not None else m.every
        if self._path is None or self.dirty and m.mode == "triggered" or limit is not None and age > limit:
            self.rebuild()
        return self._read()

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(self._path)

    def rebuild(self) -> int:
        """Write the whole view anew; returns its rows. Readers keep the table they began with."""
        if not self.folder:
            raise ValueError(f"{self.name} has no folder to be kept in")
        path, plan = f"{self.folder}/{self.name}-{uuid.uuid4().hex}", self.plan()
        writer = plan.write
        (writer.partitionBy(self.scope) if self.scope else writer).parquet(path)
        self._path, self.refreshed, self.dirty = path, time.time(), False
        return self._read().count()

    def refresh(self, scopes: list) -> int:
        """Write anew only the rows of the given scopes; the others' files stay.

        The plan is filtered by scope before it runs (the filter reaches the scans where the scope is
        one of their columns), and only those partitions of the table are overwritten. A scope that has
        no rows any more is emptied.
        """
        if self.scope is None or self._path is None:
            return self.rebuild()
        wanted = F.col(self.scope).isin([s for s in scopes if s is not None])
        fresh = self.plan().where(wanted | F.col(self.scope).isNull() if None in scopes else wanted)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        rows = fresh.cache()
        n = rows.count()
        left = {r[0] for r in rows.select(self.scope).distinct().collect()}  # at most the scopes asked for
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.scope).parquet(self._path)
        rows.unpersist()
        for s in scopes:
            if s not in left:
                p = path(f"{self._path}/{folder(self.scope, None if s is None else str(s))}")  # as the writer names it
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.refreshed = time.time()
        return n

    def mark(self) -> None:
        """Note a change; many changes before the next read cost one rebuild."""
        self.dirty = True
