"""Models: which fields a collection has, and how they may be used."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters as fl
from .functions import geo as g
from .functions import text as tx


class NonIndexedFieldError(ValueError):
    """A strict model was asked about a field that isn't indexed."""


@dataclass(frozen=True)
class Field:
    """A column, or (``derive``) an expression over columns. Comparison methods make filters."""

    name: str
    kind: T.DataType | None = None
    indexed: bool = False
    unique: bool = False
    tokenized: bool = False
    facet: bool = False
    hierarchical: bool = False
    metric: str | None = None
    dimension: int | None = None
    stored: bool = True
    derive: Callable[[], Column] | None = None
    tokenizer: str = "space"

    # how it may be used

    def index(self) -> Field:
        return replace(self, indexed=True)

    def as_unique(self) -> Field:
        return replace(self, indexed=True, unique=True)

    def as_tokenized(self, tokenizer: str = "space") -> Field:
        return replace(self, indexed=True, tokenized=True, tokenizer=tokenizer)

    def as_facet(self, hierarchical: bool = False) -> Field:
        return replace(self, indexed=True, facet=True, hierarchical=hierarchical)

    def as_vector(self, dimension: int, metric: str = "cosine") -> Field:
        return replace(self, indexed=True, dimension=dimension, metric=metric)

    # filters

    def __eq__(self, value: Any) -> fl.Filter:  # type: ignore[override]
        return fl.Tokens(self.name, value, kind=self.tokenizer) if self.tokenized and isinstance(value, str) else fl.Equals(self.name, value)

    def __ne__(self, value: Any) -> fl.Filter:  # type: ignore[override]
        return fl.Tokens(self.name, value, True, self.tokenizer) if self.tokenized and isinstance(value, str) else fl.NotEquals(self.name, value)

    def __hash__(self) -> int:
        return hash(self.name)

    def __gt__(self, v: Any) -> fl.Filter:
        return fl.Range(self.name, v, None, low_included=False)

    def __ge__(self, v: Any) -> fl.Filter:
        return fl.Range(self.name, v, None)

    def __lt__(self, v: Any) -> fl.Filter:
        return fl.Range(self.name, None, v, high_included=False)

    def __le__(self, v: Any) -> fl.Filter:
        return fl.Range(self.name, None, v)

    def between(self, low: Any, high: Any) -> fl.Filter:
        return fl.Range(self.name, low, high)

    def range(self, low: Any = None, high: Any = None, low_included: bool = True, high_included: bool = True) -> fl.Filter:
        return fl.Range(self.name, low, high, low_included, high_included)

    def is_in(self, values: Sequence) -> fl.Filter:
        return fl.In(self.name, tuple(values))

    def is_null(self) -> fl.Filter:
        return fl.Equals(self.name, None)

    def is_not_null(self) -> fl.Filter:
        return fl.NotEquals(self.name, None)

    def regex(self, pattern: str) -> fl.Filter:
        return fl.Text(self.name, "regex", pattern)

    def starts_with(self, s: str, ci: bool = False) -> fl.Filter:
        return fl.Text(self.name, "starts", s, ci)

    def ends_with(self, s: str, ci: bool = False) -> fl.Filter:
        return fl.Text(self.name, "ends", s, ci)

    def contains(self, s: str, ci: bool = False) -> fl.Filter:
        return fl.Text(self.name, "contains", s, ci)

    def exactly(self, s: str, ci: bool = False) -> fl.Filter:
        return fl.Text(self.name, "exactly", s, ci)

    def words(self, s: str, match_starts: bool = True, match_ends: bool = False) -> fl.Filter:
        """Every word of ``s`` is in the value: anywhere, at its start, its end, or as the whole."""
        how = "contains" if match_starts and match_ends else "starts" if match_starts else "ends" if match_ends else "exactly"
        return fl.every(*(fl.Text(self.name, how, w) for w in s.split())) if s.split() else fl.Everything()

    def has(self, value: Any) -> fl.Filter:
        return fl.Equals(self.name, [value])

    def has_any(self, values: Sequence) -> fl.Filter:
        return fl.In(self.name, tuple(values))

    def has_all(self, values: Sequence) -> fl.Filter:
        return fl.Equals(self.name, list(values))

    def drill_down(self, *path: str, only_this_level: bool = False) -> fl.Filter:
        return fl.DrillDown(self.name, tuple(path), only_this_level)

    def nested(self, build: Callable[[Nested], fl.Filter] | fl.Filter) -> fl.Filter:
        return fl.Nested(self.name, build if isinstance(build, fl.Filter) else build(Nested()))

    def within(self, center: g.Geo, meters: float) -> fl.Filter:
        return fl.Within(self.name, center, meters)

    def spatial_contains(self, geo: g.Geo) -> fl.Filter:
        return fl.Spatial(self.name, "contains", geo)

    def spatial_intersects(self, geo: g.Geo) -> fl.Filter:
        return fl.Spatial(self.name, "intersects", geo)

    # sorting

    def asc(self) -> Sort:
        return Sort(field=self.name)

    def desc(self) -> Sort:
        return Sort(field=self.name, descending=True)

    def knn(self, vector: Sequence[float], metric: str | None = None) -> Sort:
        return Sort(field=self.name, vector=tuple(float(v) for v in vector), metric=metric or self.metric or "cosine")

    def by_distance(self, center: g.Geo) -> Sort:
        return Sort(field=self.name, center=center)

    # aggregates

    def _agg(self, kind: str) -> Any:
        from .aggregate import Aggregate

        return Aggregate(self.name, kind)

    def max(self) -> Any:
        return self._agg("max")

    def min(self) -> Any:
        return self._agg("min")

    def avg(self) -> Any:
        return self._agg("avg")

    def sum(self) -> Any:
        return self._agg("sum")

    def count(self) -> Any:
        return self._agg("count")

    def count_distinct(self) -> Any:
        return self._agg("countDistinct")

    def count_distinct_approx(self) -> Any:
        return self._agg("countDistinctApprox")

    def group(self) -> Any:
        return self._agg("group")

    def concat(self) -> Any:
        return self._agg("concat")

    def concat_distinct(self) -> Any:
        return self._agg("concatDistinct")


class Nested:
    """Fields of an array's elements, by attribute."""

    def __getattr__(self, name: str) -> Field:
        return Field(name)


@dataclass(frozen=True)
class Sort:
    field: str | None = None  # None: the collection's own order, by id
    descending: bool = False
    vector: tuple[float, ...] | None = None
    metric: str = "cosine"
    center: g.Geo | None = None
    best: bool = False

    @staticmethod
    def index_order() -> Sort:
        return Sort()

    @staticmethod
    def best_match() -> Sort:
        return Sort(best=True, descending=True)


class Model:
    """Fields by attribute, or by item where a method has their name; ``key`` names the id."""

    def __init__(self, name: str, *fields: Field, key: str = "_id", strict: bool = False):
        self.model_name, self.key, self.strict = name, key, strict
        self.fields = {f.name: f for f in fields}
        if key not in self.fields:
            self.fields = {key: Field(key, indexed=True, unique=True), **self.fields}

    def __getattr__(self, name: str) -> Field:
        try:
            return self.__dict__["fields"][name]
        except KeyError:
            raise AttributeError(f"{self.__dict__.get('model_name')} has no field {name}") from None

    def __getitem__(self, name: str) -> Field:
        return self.fields[name]

    def field(self, name: str) -> Field:
        return self.fields.get(name) or Field(name)

    def builder(self) -> fl.Builder:
        return fl.Builder()

    @property
    def indexed(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.indexed]

    @staticmethod
    def of(name: str, df: DataFrame, key: str = "_id", **fields: Field) -> Model:
        """A model of all columns of a DataFrame, all indexed; ``fields`` add to or replace them."""
        own = {f.name: Field(f.name, f.dataType, indexed=True) for f in df.schema.fields}
        return Model(name, *(own | fields).values(), key=key)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.kind or T.StringType(), f.name != self.key) for f in self.fields.values() if f.derive is None])

    def apply(self, df: DataFrame) -> DataFrame:
        """The DataFrame with derived fields, and missing columns as nulls."""
        missing = {f.name: F.lit(None).cast(f.kind) for f in self.fields.values() if f.derive is None and f.kind is not None and f.name not in df.columns}
        derived = {f.name: f.derive() for f in self.fields.values() if f.derive is not None}
        return df.withColumns(missing).withColumns(derived) if missing or derived else df

    def check(self, names: set[str]) -> None:
        if self.strict and (bad := sorted(n for n in names if not self.field(n.split(".")[0]).indexed)):
            raise NonIndexedFieldError(f"not indexed in {self.model_name}: {', '.join(bad)}")


def tokens_of(f: Field) -> Column:
    return tx.tokens(F.col(f.name), f.tokenizer)
