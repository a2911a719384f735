"""Aggregate queries: groups, functions, filters on results, nested buckets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .query import Query


@dataclass(frozen=True)
class Aggregate:
    """A function of a field; its result is named as field and function together (``ageMax``)."""

    field: str
    kind: str
    name_: str | None = None
    sub: tuple[Aggregate, ...] = ()

    @property
    def name(self) -> str:
        return self.name_ or self.field.replace(".", "_") + self.kind[0].upper() + self.kind[1:]

    def as_(self, name: str) -> Aggregate:
        return replace(self, name_=name)

    def with_sub_aggregates(self, *sub: Aggregate) -> Aggregate:
        return replace(self, sub=sub)

    def column(self, key: str) -> Column:
        c = F.col(self.field)
        if self.kind in ("max", "min", "avg", "sum", "count"):
            out = getattr(F, self.kind)(c)
        elif self.kind == "countDistinct":
            out = F.count_distinct(c)
        elif self.kind == "countDistinctApprox":
            out = F.approx_count_distinct(c)
        elif self.kind == "concat":
            # values in the order of ids, nulls left out
            out = F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(key).alias("k"), c.alias("v"))))), lambda x: x["v"])
        elif self.kind == "concatDistinct":
            out = F.array_sort(F.collect_set(c))
        else:
            raise ValueError(f"unknown function {self.kind}")
        return out.alias(self.name)

    # conditions on results

    def _test(self, op: str, value: Any) -> Having:
        return Having(self.name, op, value)

    def __eq__(self, value: Any) -> Having:  # type: ignore[override]
        return self._test("=", value)

    def __ne__(self, value: Any) -> Having:  # type: ignore[override]
        return self._test("!=", value)

    def __hash__(self) -> int:
        return hash((self.field, self.kind, self.name_))

    def __gt__(self, v: Any) -> Having:
        return self._test(">", v)

    def __ge__(self, v: Any) -> Having:
        return self._test(">=", v)

    def __lt__(self, v: Any) -> Having:
        return self._test("<", v)

    def __le__(self, v: Any) -> Having:
        return self._test("<=", v)

    def between(self, low: Any, high: Any) -> Having:
        return self._test("between", (low, high))

    def is_in(self, values: Sequence) -> Having:
        return self._test("in", tuple(values))

    def regex(self, p: str) -> Having:
        return self._test("regex", p)

    def starts_with(self, s: str) -> Having:
        return self._test("starts", s)

    def ends_with(self, s: str) -> Having:
        return self._test("ends", s)

    def contains(self, s: str) -> Having:
        return self._test("contains", s)

    def asc(self) -> tuple[str, bool]:
        return self.name, False

    def desc(self) -> tuple[str, bool]:
        return self.name, True


@dataclass(frozen=True)
class Having:
    name: str
    op: str
    value: Any
    more: tuple[Having, ...] = ()

    def __and__(self, other: Having) -> Having:
        return replace(self, more=(*self.more, other))

    def column(self) -> Column:
        c, v = F.col(self.name), self.value
        tests = {
            "=": lambda: c.eqNullSafe(F.lit(v)),
            "!=": lambda: ~c.eqNullSafe(F.lit(v)),
            ">": lambda: c > v,
            ">=": lambda: c >= v,
            "<": lambda: c < v,
            "<=": lambda: c <= v,
            "between": lambda: c.between(*v),
            "in": lambda: c.isin(*v),
            "regex": lambda: c.cast("string").rlike(v),
            "starts": lambda: c.cast("string").startswith(v),
            "ends": lambda: c.cast("string").endswith(v),
            "contains": lambda: c.cast("string").contains(v),
        }
        out = F.coalesce(tests[self.op](), F.lit(False))
        for m in self.more:
            out = out & m.column()
        return out


@dataclass(frozen=True)
class AggregateQuery:
    query: Query
    functions: tuple[Aggregate, ...]
    having: tuple[Having, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    limit_: int | None = None

    def filter(self, *having: Having) -> AggregateQuery:
        return replace(self, having=self.having + having)

    def sort(self, *order: tuple[str, bool] | Aggregate) -> AggregateQuery:
        return replace(self, order=self.order + tuple(o.asc() if isinstance(o, Aggregate) else o for o in order))

    def limit(self, n: int) -> AggregateQuery:
        return replace(self, limit_=n)

    @property
    def groups(self) -> list[Aggregate]:
        return [f for f in self.functions if f.kind == "group"]

    @property
    def df(self) -> DataFrame:
        """A row per group (one row without groups, also for no input), as plain columns."""
        rows, key = self.query._matching(), self.query.collection.model.key
        values = [f.column(key) for f in self.functions if f.kind != "group"]
        if groups := self.groups:
            by = rows.groupBy(*[F.col(f.field).alias(f.name) for f in groups])
            out = by.agg(*values) if values else rows.select(*[F.col(f.field).alias(f.name) for f in groups]).distinct()
            out = out.select(*[f.name for f in self.functions])
        else:
            out = rows.agg(*values)
        for h in self.having:
            out = out.where(h.column())
        if self.order:
            out = out.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in self.order], *[f.name for f in groups])
        return out if self.limit_ is None else out.limit(self.limit_)

    def nested(self) -> DataFrame:
        """Groups with sub-aggregates as arrays of structs, level below level.

        Each level is one aggregation over its keys and those above; the deepest is folded into its
        parent by key, so rows are shuffled once and buckets thereafter.
        """
        rows, key = self.query._matching(), self.query.collection.model.key
        return _nest(rows, key, self.functions, ())

    def count(self) -> int:
        return self.df.count()

    def list(self) -> list[Row]:
        return self.df.collect()


def _nest(rows: DataFrame, key: str, functions: tuple[Aggregate, ...], above: tuple[Aggregate, ...]) -> DataFrame:
    groups = [f for f in functions if f.kind == "group"]
    keys = [*above, *groups]
    by = [F.col(f.field).alias(f.name) for f in keys]
    values = [f.column(key) for f in functions if f.kind != "group"]
    out = rows.groupBy(*by).agg(*(values or [F.count("*").alias("docCount")]))
    for f in groups:
        if f.sub:
            names = [k.name for k in keys]
            below = _nest(rows, key, f.sub, tuple(keys))
            inner = [c for c in below.columns if c not in names]
            folded = below.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias(f"{f.name}Buckets"))
            other = folded.select(*[F.col(n).alias(f"_{n}") for n in names], f"{f.name}Buckets")
            same = F.lit(True)
            for n in names:
                same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
            out = out.join(other, same, "left").drop(*[f"_{n}" for n in names])
    return out
