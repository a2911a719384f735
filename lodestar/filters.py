"""Filters as values, and their meaning as columns.

Rules where engines differ are fixed here: ``!=`` holds for nulls; string tests never match nulls and
take ``%`` and ``_`` literally; equality of arrays means containing all; regular expressions search;
``must_not`` inside nested elements excludes the whole array if any element matches.

A column may be null where a filter doesn't match: conjunctions and disjunctions keep it so, rows are
selected only where it is true, and negations turn it into false first. Comparisons thus stay bare, and
reach the scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import geo as g
from .functions import text as tx

#: Values of an IN list from which it becomes a semi-join.
LARGE_IN = 1000


class Filter:
    """Combine with ``&``, ``|`` and ``~``; they mean and, or, not, whatever is combined."""

    def __and__(self, other: Filter) -> Filter:
        return Multi((Clause(self, "must"), Clause(other, "must")))

    def __or__(self, other: Filter) -> Filter:
        return Multi((Clause(self, "should"), Clause(other, "should")), 1)

    def __invert__(self) -> Filter:
        return Multi((Clause(self, "must_not"),))

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def score(self, scope: Scope) -> Column:
        """What a match adds to a row's score."""
        return F.when(F.coalesce(self.column(scope), F.lit(False)), 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Scope:
    """Where a filter's fields are found: columns of a row, or fields of a nested element."""

    get: Callable[[str], Column]
    kind: Callable[[str], T.DataType | None]
    tokens: Callable[[str], Column] | None = None
    flags: dict | None = None

    def is_array(self, name: str) -> bool:
        return isinstance(self.kind(name), T.ArrayType)


def _literal(value: Any) -> Column:
    if isinstance(value, (list, tuple, set, frozenset)):
        return F.array(*[F.lit(v) for v in value])
    return value if isinstance(value, Column) else F.lit(value)


def _any(scope: Scope, name: str, test: Callable[[Column], Column]) -> Column:
    """A test of a value, or of any element of an array; null never passes."""
    c = scope.get(name)
    if scope.is_array(name):
        return F.exists(c, lambda x: F.coalesce(test(x.cast("string")), F.lit(False)))
    return test(c if isinstance(scope.kind(name), T.StringType) else c.cast("string"))


@dataclass(frozen=True)
class Equals(Filter):
    field: str
    value: Any

    def column(self, scope: Scope) -> Column:
        c = scope.get(self.field)
        if self.value is None:
            return c.isNull()
        if scope.is_array(self.field):
            wanted = list(self.value) if isinstance(self.value, (list, tuple, set, frozenset)) else [self.value]
            if not wanted:
                return c.isNotNull()
            return F.coalesce(F.size(F.array_except(_literal(wanted), c)) == 0, F.lit(False))
        return F.coalesce(c == _literal(self.value), F.lit(False)) if not _pushable(self.value) else c.eqNullSafe(_literal(self.value))


def _pushable(value: Any) -> bool:
    return isinstance(value, (str, int, float, bool))


@dataclass(frozen=True)
class NotEquals(Filter):
    field: str
    value: Any

    def column(self, scope: Scope) -> Column:
        return ~F.coalesce(Equals(self.field, self.value).column(scope), F.lit(False))


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: tuple

    def column(self, scope: Scope) -> Column:
        c, some = scope.get(self.field), [v for v in self.values if v is not None]
        if not some:
            return F.lit(False)
        if scope.is_array(self.field):
            return F.coalesce(F.arrays_overlap(c, _literal(some)), F.lit(False))
        return c.isin(some)


@dataclass(frozen=True)
class Range(Filter):
    field: str
    low: Any = None
    high: Any = None
    low_included: bool = True
    high_included: bool = True

    def column(self, scope: Scope) -> Column:
        c = scope.get(self.field)

        def test(x: Column) -> Column:
            bounds = []
            if self.low is not None:
                bounds.append(x >= _literal(self.low) if self.low_included else x > _literal(self.low))
            if self.high is not None:
                bounds.append(x <= _literal(self.high) if self.high_included else x < _literal(self.high))
            return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else x.isNotNull()

        if scope.is_array(self.field):
            return F.coalesce(F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
        return test(c)


@dataclass(frozen=True)
class Text(Filter):
    """starts, ends, contains, exactly or regex; ``ci`` ignores case."""

    field: str
    how: str
    value: str
    ci: bool = False

    def column(self, scope: Scope) -> Column:
        value = self.value.lower() if self.ci and self.how != "regex" else self.value

        def test(x: Column) -> Column:
            own = F.lower(x) if self.ci and self.how != "regex" else x
            if self.how == "starts":
                return own.startswith(value)
            if self.how == "ends":
                return own.endswith(value)
            if self.how == "contains":
                return own.contains(value)
            if self.how == "exactly":
                return own == F.lit(value)
            return own.rlike(("(?i)" if self.ci else "") + value)

        if self.how == "regex" and not _valid(value):
            return F.lit(False)
        return _any(scope, self.field, test)


def _valid(pattern: str) -> bool:
    """Whether the JVM can compile a pattern; without a session, whether Python can."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        try:
            re.compile(pattern)
            return True
        except re.error:
            return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception as e:
        if type(e).__name__ == "IllegalArgumentException" or "PatternSyntaxException" in str(e):
            return False
        raise


@dataclass(frozen=True)
class Tokens(Filter):
    """All (or, negated, not all) tokens of a text are among a tokenized field's."""

    field: str
    text: str
    negated: bool = False
    kind: str = "space"

    def column(self, scope: Scope) -> Column:
        found = F.coalesce(tx.has_all(tx.tokens(scope.get(self.field), self.kind), tx.query_tokens(self.text, self.kind)), F.lit(False))
        return ~found if self.negated else found

    def score(self, scope: Scope) -> Column:
        return F.coalesce(tx.overlap(tx.tokens(scope.get(self.field), self.kind), tx.query_tokens(self.text, self.kind)), F.lit(0.0))


@dataclass(frozen=True)
class DrillDown(Filter):
    """Facet paths at or below (only_this_level: at) a path."""

    field: str
    path: tuple[str, ...]
    only_this_level: bool = False

    def column(self, scope: Scope) -> Column:
        paths, own = scope.get(self.field), F.array(*map(F.lit, self.path)) if self.path else F.array().cast("array<string>")
        if self.only_this_level:
            test = lambda p: p == own
        else:
            test = lambda p: F.slice(p, 1, len(self.path)) == own if self.path else F.lit(True)
        return F.coalesce(F.exists(paths, test), F.lit(False))


@dataclass(frozen=True)
class Within(Filter):
    """A point, geometry or any of an array of geometries at most ``meters`` from another."""

    field: str
    center: g.Geo
    meters: float

    def column(self, scope: Scope) -> Column:
        return F.coalesce(nearest(scope, self.field, self.center) <= self.meters, F.lit(False))


def nearest(scope: Scope, field: str, to: g.Geo) -> Column:
    """Metres from a field of points or geometries, the least of an array; null where there is none."""
    c, kind = scope.get(field), scope.kind(field)
    if isinstance(kind, T.ArrayType):
        return F.array_min(g.distances(c, to))
    if isinstance(kind, T.StructType) and "lat" in kind.names:
        lat, lon = to.center()
        return g.haversine(c["lat"], c["lon"], F.lit(lat), F.lit(lon))
    return g.distance(c, to)


@dataclass(frozen=True)
class Spatial(Filter):
    field: str
    how: str
    geo: g.Geo

    def column(self, scope: Scope) -> Column:
        c, kind = scope.get(self.field), scope.kind(self.field)
        if isinstance(kind, T.StructType) and "lat" in kind.names:
            if self.how == "intersects" and self.geo.kind == "Polygon":
                return F.coalesce(g.point_in(c["lat"], c["lon"], self.geo), F.lit(False))
            c = F.array(F.struct(F.lit("Point").alias("kind"), F.array(F.array(c)).alias("parts")))
        elif not isinstance(kind, T.ArrayType):
            c = F.array(c)
        return (g.spatial_contains if self.how == "contains" else g.spatial_intersects)(c, self.geo)


@dataclass(frozen=True)
class Nothing(Filter):
    def column(self, scope: Scope) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class Everything(Filter):
    def column(self, scope: Scope) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Expression(Filter):
    """Any column expression."""

    expr: Column

    def column(self, scope: Scope) -> Column:
        return F.coalesce(self.expr, F.lit(False))


@dataclass(frozen=True)
class Clause:
    filter: Filter
    condition: str = "must"  # must, must_not, filter, should
    boost: float = 1.0


@dataclass(frozen=True)
class Multi(Filter):
    """All must and filter clauses, no must_not clause, and at least ``min_should`` should clauses if there are any."""

    clauses: tuple[Clause, ...]
    min_should: int = 0

    def _of(self, *conditions: str) -> list[Clause]:
        return [c for c in self.clauses if c.condition in conditions]

    def column(self, scope: Scope) -> Column:
        out = None
        for c in self._of("must", "filter"):
            own = c.filter.column(scope)
            out = own if out is None else out & own
        for c in self._of("must_not"):
            own = ~F.coalesce(c.filter.column(scope), F.lit(False))
            out = own if out is None else out & own
        should = self._of("should")
        if should and self.min_should > 0:
            each = [c.filter.column(scope) for c in should]
            if self.min_should == 1:
                own = each[0]
                for e in each[1:]:
                    own = own | e
            else:
                each = [F.coalesce(e, F.lit(False)) for e in each]
                own = sum((e.cast("int") for e in each[1:]), each[0].cast("int")) >= self.min_should
            out = own if out is None else out & own
        return F.lit(True) if out is None else out

    def score(self, scope: Scope) -> Column:
        out = F.lit(0.0)
        for c in self._of("must", "should"):
            hit = F.coalesce(c.filter.column(scope), F.lit(False))
            out = out + F.when(hit, c.filter.score(scope) * c.boost).otherwise(0.0)
        return out


@dataclass(frozen=True)
class Nested(Filter):
    """One element of an array of structs passes the filter; see the module's text for must_not."""

    path: str
    filter: Filter

    def column(self, scope: Scope) -> Column:
        kind = scope.kind(self.path)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            raise ValueError(f"{self.path} isn't an array of structs")
        _no_spatial(self.filter)
        types = {f.name: f.dataType for f in kind.elementType.fields}
        inner = lambda x: Scope(lambda n: _path(x, n), lambda n: _path_type(types, n))
        array = scope.get(self.path)
        yes, no = _without_must_not(self.filter)
        out = _some_element(array, yes, inner)
        for f in no:
            out = out & ~_some_element(array, f, inner)
        return out


def _some_element(array: Column, f: Filter, inner: Callable[[Column], Scope]) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(f.column(inner(x)), F.lit(False))), F.lit(False))


def _path(x: Column, name: str) -> Column:
    for part in name.split("."):
        x = x[part]
    return x


def _path_type(types: dict, name: str) -> T.DataType | None:
    first, _, rest = name.partition(".")
    kind = types.get(first)
    if rest and isinstance(kind, T.StructType):
        return _path_type({f.name: f.dataType for f in kind.fields}, rest)
    return kind


def _without_must_not(f: Filter) -> tuple[Filter, list[Filter]]:
    """The positive part, and what no element may match."""
    if not isinstance(f, Multi):
        return f, []
    no, yes = [], []
    for c in f.clauses:
        if c.condition == "must_not":
            no.append(c.filter)
        elif c.condition in ("must", "filter"):
            inner, more = _without_must_not(c.filter)
            yes.append(Clause(inner, c.condition, c.boost))
            no += more
        else:
            yes.append(c)
    return Multi(tuple(yes), f.min_should), no


def _no_spatial(f: Filter) -> None:
    if isinstance(f, (Spatial, Within)):
        raise ValueError("spatial filters aren't supported inside nested filters")
    for c in f.clauses if isinstance(f, Multi) else ():
        _no_spatial(c.filter)


@dataclass(frozen=True)
class ExistsChild(Filter):
    """Some row of another collection whose ``foreign_key`` is this row's ``key`` passes ``filter``."""

    children: Any  # a Collection
    foreign_key: str
    filter: Filter
    key: str = "_id"

    def column(self, scope: Scope) -> Column:
        if not scope.flags or self not in scope.flags:
            raise ValueError("a child filter needs a query over the parents")
        return F.coalesce(F.col(scope.flags[self]), F.lit(False))

    def keys(self) -> DataFrame:
        found = self.children.query().filter(self.filter).df
        return found.select(F.col(self.foreign_key).alias("key")).where("key IS NOT NULL")

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other: object) -> bool:
        return self is other


def same_child(children: Any, foreign_key: str, filters: Sequence[Filter], key: str = "_id") -> Filter:
    """One child passes all filters; without filters, there is a child."""
    return ExistsChild(children, foreign_key, every(*filters) if filters else Everything(), key)


def collective(children: Any, foreign_key: str, filters: Sequence[Filter], key: str = "_id") -> Filter:
    """Each filter is passed by some child; without filters, every row passes."""
    return every(*(ExistsChild(children, foreign_key, f, key) for f in filters)) if filters else Everything()


def every(*filters: Filter) -> Filter:
    return filters[0] if len(filters) == 1 else Multi(tuple(Clause(f, "must") for f in filters))


def some(*filters: Filter) -> Filter:
    return Multi(tuple(Clause(f, "should") for f in filters), 1) if filters else Nothing()


def child_filters(f: Filter) -> list[ExistsChild]:
    if isinstance(f, ExistsChild):
        return [f]
    return [x for c in f.clauses for x in child_filters(c.filter)] if isinstance(f, Multi) else []


def conjuncts(f: Filter) -> list[Filter]:
    """Filters that must all hold, taken out of plain conjunctions."""
    if isinstance(f, Multi) and all(c.condition in ("must", "filter") for c in f.clauses):
        return [x for c in f.clauses for x in conjuncts(c.filter)]
    return [f]


class Builder:
    """must, must_not, filter and should clauses, one after another."""

    def __init__(self, clauses: tuple[Clause, ...] = (), min_should: int = 1):
        self._clauses, self._min = clauses, min_should

    def min_should(self, n: int) -> Builder:
        return Builder(self._clauses, n)

    def _with(self, f: Filter, condition: str, boost: float) -> Builder:
        return Builder((*self._clauses, Clause(f, condition, boost)), self._min)

    def must(self, f: Filter, boost: float = 1.0) -> Builder:
        return self._with(f, "must", boost)

    def must_not(self, f: Filter) -> Builder:
        return self._with(f, "must_not", 1.0)

    def filter(self, f: Filter) -> Builder:
        return self._with(f, "filter", 1.0)

    def should(self, f: Filter, boost: float = 1.0) -> Builder:
        return self._with(f, "should", boost)

    def build(self) -> Multi:
        return Multi(self._clauses, self._min)
