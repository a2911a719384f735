"""SQL: texts with parameters, and a builder that writes them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_HOLE = re.compile(r"\{(\w+)\}")


def run(spark: SparkSession, text: str, *positional: Any, tables: dict[str, DataFrame] | None = None, **named: Any) -> DataFrame:
    """A query with ``?`` or ``:name`` parameters (bound, never pasted) and ``{table}`` placeholders for DataFrames."""
    if positional and named:
        raise ValueError("use positional or named parameters, not both")
    args = list(positional) if positional else named
    return spark.sql(text, args=args or None, **(tables or {}))


def fill(text: str, parts: dict[str, str]) -> str:
    """Replace ``{name}`` by SQL text where ``parts`` has it; other holes stay."""
    return _HOLE.sub(lambda m: parts.get(m[1], m[0]), text)


@dataclass(frozen=True)
class Sql:
    """A piece of SQL with its named parameters."""

    text: str
    args: tuple[tuple[str, Any], ...] = ()

    def __and__(self, other: Sql) -> Sql:
        return _join(self, " AND ", other)

    def __or__(self, other: Sql) -> Sql:
        return _join(self, " OR ", other)

    def __invert__(self) -> Sql:
        return Sql(f"NOT ({self.text})", self.args)

    def as_(self, name: str) -> Sql:
        return Sql(f"{self.text} AS {name}", self.args)

    def desc(self) -> Sql:
        return Sql(f"{self.text} DESC", self.args)

    def _op(self, op: str, value: Any) -> Sql:
        v = value if isinstance(value, (Sql, Select)) else lit(value)
        v = v.sql(True) if isinstance(v, Select) else v
        return Sql(f"{self.text} {op} {v.text}", self.args + v.args)

    def eq(self, v: Any) -> Sql:
        return self._op("=", v)

    def ne(self, v: Any) -> Sql:
        return self._op("<>", v)

    def lt(self, v: Any) -> Sql:
        return self._op("<", v)

    def le(self, v: Any) -> Sql:
        return self._op("<=", v)

    def gt(self, v: Any) -> Sql:
        return self._op(">", v)

    def ge(self, v: Any) -> Sql:
        return self._op(">=", v)

    def like(self, v: str) -> Sql:
        return self._op("LIKE", v)

    def is_null(self) -> Sql:
        return Sql(f"{self.text} IS NULL", self.args)

    def is_not_null(self) -> Sql:
        return Sql(f"{self.text} IS NOT NULL", self.args)

    def is_in(self, values: Sequence | Select, negated: bool = False) -> Sql:
        op = "NOT IN" if negated else "IN"
        if isinstance(values, Select):
            inner = values.sql(True)
            return Sql(f"{self.text} {op} {inner.text}", self.args + inner.args)
        items = [lit(v) for v in values]
        return Sql(f"{self.text} {op} ({', '.join(i.text for i in items)})", self.args + tuple(a for i in items for a in i.args))


def _join(a: Sql, op: str, b: Sql) -> Sql:
    return Sql(f"({a.text}){op}({b.text})", a.args + b.args)


_count = iter(range(1 << 60))


def lit(value: Any) -> Sql:
    """A bound parameter."""
    if value is None:
        return Sql("NULL")
    name = f"p{next(_count)}"
    return Sql(f":{name}", ((name, value),))


def col(name: str) -> Sql:
    return Sql(name)


def raw(text: str) -> Sql:
    return Sql(text)


def call(name: str, *args: Sql | Any) -> Sql:
    items = [a if isinstance(a, Sql) else lit(a) for a in args]
    return Sql(f"{name}({', '.join(i.text for i in items)})", tuple(x for i in items for x in i.args))


def cast(x: Sql, kind: str) -> Sql:
    return Sql(f"CAST({x.text} AS {kind})", x.args)


def coalesce(*args: Any) -> Sql:
    return call("coalesce", *args)


def greatest(*args: Any) -> Sql:
    return call("greatest", *args)


def least(*args: Any) -> Sql:
    return call("least", *args)


def count_all() -> Sql:
    return Sql("count(*)")


def typed_null(kind: str) -> Sql:
    return Sql(f"CAST(NULL AS {kind})")


def array(*items: Any) -> Sql:
    return call("array", *items)


def position(a: Sql, value: Any) -> Sql:
    inner = call("array_position", a, value)
    return Sql(f"nullif({inner.text}, 0)", inner.args)


def array_contains(c: Sql, value: Any, kind: str = "string") -> Sql:
    """Whether a JSON array in a text column has a value."""
    inner = call("array_contains", Sql(f"from_json({c.text}, 'array<{kind}>')", c.args), value)
    return Sql(f"coalesce({inner.text}, false)", inner.args)


def case(*branches: tuple[Sql, Any], otherwise: Any = None) -> Sql:
    text, args = "CASE", ()
    for when, then in branches:
        then = then if isinstance(then, Sql) else lit(then)
        text, args = f"{text} WHEN {when.text} THEN {then.text}", args + when.args + then.args
    other = otherwise if isinstance(otherwise, Sql) else lit(otherwise)
    return Sql(f"{text} ELSE {other.text} END", args + other.args)


def exists(q: Select, negated: bool = False) -> Sql:
    inner = q.sql(True)
    return Sql(f"{'NOT ' if negated else ''}EXISTS {inner.text}", inner.args)


def scalar(q: Select) -> Sql:
    return q.sql(True)


@dataclass(frozen=True)
class Select:
    """SELECT, written piece by piece."""

    columns: tuple[Sql, ...]
    source: str = ""
    joins: tuple[Sql, ...] = ()
    conditions: tuple[Sql, ...] = ()
    groups: tuple[Sql, ...] = ()
    havings: tuple[Sql, ...] = ()
    orders: tuple[Sql, ...] = ()
    limit_: int | None = None
    offset_: int | None = None
    unions: tuple[tuple[str, Select], ...] = ()
    unique: bool = False

    def distinct(self) -> Select:
        return replace(self, unique=True)

    def from_(self, table: str | Select, alias: str | None = None) -> Select:
        text = f"({table.sql().text})" if isinstance(table, Select) else table
        out = replace(self, source=f"{text} {alias}" if alias else text)
        return replace(out, joins=(*out.joins, Sql("", table.sql().args))) if isinstance(table, Select) and table.sql().args else out

    def _join(self, kind: str, table: str, on: Sql | None) -> Select:
        return replace(self, joins=(*self.joins, Sql(f"{kind} JOIN {table}" + (f" ON {on.text}" if on else ""), on.args if on else ())))

    def join(self, table: str, on: Sql) -> Select:
        return self._join("INNER", table, on)

    def left_join(self, table: str, on: Sql) -> Select:
        return self._join("LEFT", table, on)

    def right_join(self, table: str, on: Sql) -> Select:
        return self._join("RIGHT", table, on)

    def full_join(self, table: str, on: Sql) -> Select:
        return self._join("FULL OUTER", table, on)

    def cross_join(self, table: str) -> Select:
        return self._join("CROSS", table, None)

    def where(self, *conditions: Sql) -> Select:
        return replace(self, conditions=self.conditions + conditions)

    def group_by(self, *groups: Sql) -> Select:
        return replace(self, groups=self.groups + groups)

    def having(self, *havings: Sql) -> Select:
        return replace(self, havings=self.havings + havings)

    def order_by(self, *orders: Sql) -> Select:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Select:
        return replace(self, limit_=n)

    def offset(self, n: int) -> Select:
        return replace(self, offset_=n)

    def union(self, other: Select) -> Select:
        return replace(self, unions=(*self.unions, ("UNION", other)))

    def union_all(self, other: Select) -> Select:
        return replace(self, unions=(*self.unions, ("UNION ALL", other)))

    def sql(self, nested: bool = False) -> Sql:
        args: tuple = ()

        def take(items: Sequence[Sql], sep: str) -> str:
            nonlocal args
            args += tuple(a for i in items for a in i.args)
            return sep.join(i.text for i in items)

        text = ("SELECT DISTINCT " if self.unique else "SELECT ") + take(self.columns, ", ")
        if self.source:
            text += f" FROM {self.source}"
        if self.joins:
            text += " " + take(self.joins, " ")
        if self.conditions:
            text += " WHERE " + take([Sql(f"({c.text})", c.args) for c in self.conditions], " AND ")
        if self.groups:
            text += " GROUP BY " + take(self.groups, ", ")
        if self.havings:
            text += " HAVING " + take(self.havings, " AND ")
        for how, other in self.unions:
            inner = other.sql()
            text += f" {how} {inner.text}"
            args += inner.args
        if self.orders:
            text += " ORDER BY " + take(self.orders, ", ")
        if self.limit_ is not None:
            text += f" LIMIT {self.limit_}"
        if self.offset_ is not None:
            text += f" OFFSET {self.offset_}"
        return Sql(f"({text})" if nested else text, args)

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """DataFrames given by name are registered as temporary views first."""
        s = self.sql()
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(s.text, args=dict(s.args) or None)


def select(*columns: Sql | str) -> Select:
    return Select(tuple(col(c) if isinstance(c, str) else c for c in columns))
