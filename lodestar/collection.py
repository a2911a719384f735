"""Collections and databases: rows with a model, changed in transactions that make new DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import filters as fl
from .model import Model
from .query import Query


class DuplicateIdError(ValueError):
    """An insert met an id that is there already."""


@dataclass
class Collection:
    """``stored`` has the rows; ``df`` also the model's derived fields."""

    model: Model
    stored: DataFrame
    listeners: list[Callable[[DataFrame, DataFrame], None]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.stored.sparkSession

    @property
    def df(self) -> DataFrame:
        return self.model.apply(self.stored)

    def query(self) -> Query:
        return Query(self)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def exists_child(self, children: Collection, foreign_key: str, f: fl.Filter) -> fl.Filter:
        return fl.ExistsChild(children, foreign_key, f, self.model.key)

    # reading by id

    def get(self, key: Any) -> Row | None:
        return self.df.where(F.col(self.model.key) == F.lit(key)).first()

    def __getitem__(self, key: Any) -> Row:
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def get_all(self, keys: Sequence | DataFrame) -> DataFrame:
        """Rows of the ids; many of them are joined instead of listed."""
        k = self.model.key
        if not isinstance(keys, DataFrame):
            if len(keys) < fl.LARGE_IN:
                return self.df.where(F.col(k).isin(list(keys)))
            keys = self.spark.createDataFrame([(x,) for x in keys], f"{k} {self.stored.schema[k].dataType.simpleString()}")
        return self.df.join(keys.select(F.col(keys.columns[0]).alias("_wanted")), F.col(k) == F.col("_wanted"), "left_semi")

    def get_by(self, name: str, value: Any) -> Row | None:
        """By a unique field."""
        return self.df.where(F.col(name) == F.lit(value)).limit(1).first()

    def prefix(self, start: str) -> DataFrame:
        return self.df.where(F.col(self.model.key).startswith(start)).orderBy(self.model.key)

    def count(self) -> int:
        return self.stored.count()


@dataclass
class Transaction:
    """Changes are staged as DataFrames and take effect at commit; ``with`` commits unless an error comes."""

    collection: Collection
    current: DataFrame | None = None
    changed: DataFrame | None = None

    def __post_init__(self) -> None:
        self.current = self.collection.stored

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        self.rollback() if kind else self.commit()

    @property
    def key(self) -> str:
        return self.collection.model.key

    def _rows(self, rows: DataFrame | Iterable) -> DataFrame:
        df = rows if isinstance(rows, DataFrame) else self.collection.spark.createDataFrame(list(rows), self.collection.stored.schema)
        missing = [f for f in self.collection.stored.schema.fields if f.name not in df.columns]
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*[F.col(f.name).cast(f.dataType) for f in self.collection.stored.schema.fields])

    def _note(self, keys: DataFrame) -> None:
        own = keys.select(F.col(self.key))
        self.changed = own if self.changed is None else self.changed.union(own)

    def insert(self, rows: DataFrame | Iterable) -> None:
        """Add rows; an id that is there already, or twice among them, is an error."""
        new = self._rows(rows)
        twice = new.groupBy(self.key).count().where("count > 1").select(self.key)
        known = new.join(self.current.select(F.col(self.key).alias("_old")), F.col(self.key) == F.col("_old"), "left_semi").select(self.key)
        bad = known.union(twice).first()
        if bad is not None:
            raise DuplicateIdError(f"{self.collection.model.model_name} has {bad[0]} already")
        self.current = self.current.unionByName(new)
        self._note(new)

    def upsert(self, rows: DataFrame | Iterable, order: Column | None = None) -> None:
        """Add or replace by id; of rows with one id the last by ``order`` counts (without it: any one)."""
        new = self._rows(rows)
        if order is not None:
            w = Window.partitionBy(self.key).orderBy(order.desc())
            new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        elif not isinstance(rows, DataFrame):
            last = {r[self.key] if isinstance(r, dict) else r[self.collection.stored.columns.index(self.key)]: r for r in rows}
            new = self._rows(list(last.values()))
        else:
            new = new.dropDuplicates([self.key])
        self.current = self.current.join(new.select(F.col(self.key).alias("_new")), F.col(self.key) == F.col("_new"), "left_anti").unionByName(new)
        self._note(new)

    def delete(self, *keys: Any) -> None:
        gone = self.current.where(F.col(self.key).isin(list(keys)))
        self._note(gone)
        self.current = self.current.where(~F.coalesce(F.col(self.key).isin(list(keys)), F.lit(False)))  # rows without a key stay

    def truncate(self) -> None:
        self._note(self.current)
        self.current = self.current.limit(0)

    def _query(self) -> Query:
        return Query(Collection(self.collection.model, self.current))

    def delete_where(self, f: fl.Filter, limit: int | None = None) -> None:
        q = self._query().filter(f).limit(limit)
        self._note(q.df)
        self.current = q.delete()

    def update_where(self, f: fl.Filter, **values: Any) -> None:
        q = self._query().filter(f)
        self._note(q.df)
        self.current = q.update(**values)

    def process(self, f: fl.Filter, step: Callable) -> None:
        q = self._query().filter(f)
        self._note(q.df)
        self.current = q.process(step)

    def modify(self, key: Any, step: Callable[[dict | None], dict | None]) -> dict | None:
        """Read one row, change it, write it back; None deletes it."""
        row = self.current.where(F.col(self.key) == F.lit(key)).first()
        new = step(None if row is None else row.asDict(recursive=True))
        if new is None:
            self.delete(key)
        else:
            self.upsert([tuple(new[c] for c in self.collection.stored.columns)])
        return new

    def get_or_create(self, key: Any, create: Callable[[], dict]) -> dict:
        return self.modify(key, lambda old: create() if old is None else old)

    def commit(self) -> None:
        before, self.collection.stored = self.collection.stored, self.current
        if self.changed is not None:
            for f in self.collection.listeners:
                f(before, self.changed)
        self.changed = None

    def rollback(self) -> None:
        self.current, self.changed = self.collection.stored, None


@dataclass
class Database:
    """Collections by name, on one session; ``folder`` keeps their tables."""

    spark: SparkSession
    folder: str | None = None
    collections: dict[str, Collection] = field(default_factory=dict)
    upgrades: list[tuple[str, Callable[[Database], None]]] = field(default_factory=list)
    applied: set[str] = field(default_factory=set)

    def collection(self, model: Model, rows: DataFrame | Iterable | None = None) -> Collection:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows or []), model.schema())
        own = self.collections[model.model_name] = Collection(model, df)
        return own

    def open(self, model: Model, path: str | None = None) -> Collection:
        """A collection over a parquet table; columns that the model has and the table lacks are null."""
        return self.collection(model, self.spark.read.parquet(path or f"{self.folder}/{model.model_name}"))

    def save(self, name: str, files: int | None = None, partition_by: Sequence[str] = ()) -> str:
        """Write a collection to a new table and read it from there, so that plans don't grow."""
        c = self.collections[name]
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df = c.stored if files is None else c.stored.repartition(files)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        c.stored = self.spark.read.schema(c.stored.schema).parquet(path)
        return path

    optimize = save

    def upgrade(self) -> list[str]:
        """Run upgrades that haven't run, in their order."""
        done = []
        for name, f in self.upgrades:
            if name not in self.applied:
                f(self)
                self.applied.add(name)
                done.append(name)
        return done

    def truncate(self) -> None:
        for c in self.collections.values():
            with c.transaction() as t:
                t.truncate()

    def watch(self, view: Any) -> None:
        """Mark a view whenever something that it depends on changes; with a scope, only changed parts later."""
        for name in view.relation.dependencies():
            if name in self.collections:
                self.collections[name].listeners.append(lambda _before, _changed: view.mark())
