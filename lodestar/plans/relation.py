"""Relations as values (scan, filter, project, join, aggregate, union) that become one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Relation:
    """Build with the methods; ``df()`` gives the plan. Columns of a scan are named ``alias.column``."""

    def df(self) -> DataFrame:
        raise NotImplementedError

    def dependencies(self) -> set[str]:
        return set().union(*(r.dependencies() for r in self._inputs())) if self._inputs() else set()

    def _inputs(self) -> tuple[Relation, ...]:
        return ()

    def where(self, condition: Column) -> Relation:
        return Filtered(self, condition)

    def join(self, other: Relation, on: Column, how: str = "inner") -> Relation:
        return Joined(self, other, on, how)

    def left_join(self, other: Relation, on: Column, where: Column | None = None) -> Relation:
        """``where`` narrows the right side before the join."""
        return Joined(self, other if where is None else Filtered(other, where), on, "left")

    def select(self, **columns: Column) -> Relation:
        return Projected(self, columns)

    def group_by(self, *keys: Column) -> Grouped:
        return Grouped(self, keys)

    def union_all(self, other: Relation) -> Relation:
        return Union(self, other)

    def as_(self, alias: str) -> Relation:
        return Derived(self, alias)


@dataclass(frozen=True)
class Scan(Relation):
    """A table's rows; ``source`` is asked anew each time, so a view sees its table's latest state."""

    name: str
    source: Callable[[], DataFrame]
    alias: str | None = None

    def df(self) -> DataFrame:
        return self.source().alias(self.alias or self.name)

    def dependencies(self) -> set[str]:
        return {self.name}

    def as_(self, alias: str) -> Relation:
        return Scan(self.name, self.source, alias)


@dataclass(frozen=True)
class Filtered(Relation):
    input: Relation
    condition: Column

    def df(self) -> DataFrame:
        return self.input.df().where(self.condition)

    def _inputs(self) -> tuple[Relation, ...]:
        return (self.input,)


@dataclass(frozen=True)
class Projected(Relation):
    input: Relation
    columns: dict[str, Column]

    def df(self) -> DataFrame:
        return self.input.df().select(*[c.alias(n) for n, c in self.columns.items()])

    def _inputs(self) -> tuple[Relation, ...]:
        return (self.input,)


@dataclass(frozen=True)
class Joined(Relation):
    left: Relation
    right: Relation
    on: Column
    how: str

    def df(self) -> DataFrame:
        return self.left.df().join(self.right.df(), self.on, self.how)

    def _inputs(self) -> tuple[Relation, ...]:
        return self.left, self.right


@dataclass(frozen=True)
class Grouped:
    input: Relation
    keys: tuple[Column, ...]

    def select(self, **columns: Column) -> Relation:
        """Keys and aggregates, also within CASE and other expressions."""
        return Aggregated(self.input, self.keys, columns)


@dataclass(frozen=True)
class Aggregated(Relation):
    input: Relation
    keys: tuple[Column, ...]
    columns: dict[str, Column]

    def df(self) -> DataFrame:
        out = self.input.df().groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.columns.items()])
        # by place: a key may have the name of a result
        return out.toDF(*[f"_key{i}" for i in range(len(self.keys))], *self.columns).select(*self.columns)

    def _inputs(self) -> tuple[Relation, ...]:
        return (self.input,)


@dataclass(frozen=True)
class Union(Relation):
    """All rows of both; equal rows stay."""

    first: Relation
    second: Relation

    def df(self) -> DataFrame:
        return self.first.df().unionByName(self.second.df())

    def _inputs(self) -> tuple[Relation, ...]:
        return self.first, self.second


@dataclass(frozen=True)
class Derived(Relation):
    """A relation under an alias, as a table of its own."""

    input: Relation
    alias: str

    def df(self) -> DataFrame:
        return self.input.df().alias(self.alias)

    def _inputs(self) -> tuple[Relation, ...]:
        return (self.input,)
