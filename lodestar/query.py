"""Immutable queries over collections; each call adds to the plan, nothing runs before rows are asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import filters as fl
from .functions import geo as g
from .functions import text as tx
from .functions import vectors as vx
from .model import Field, Sort

if TYPE_CHECKING:
    from .collection import Collection

PAGE = 1000


@dataclass(frozen=True)
class SearchResults:
    """A page as a DataFrame, the number of all matches if it was asked for, and facets."""

    df: DataFrame
    offset: int
    total: int | None
    facets: dict[str, Any]
    size: int

    @property
    def remaining(self) -> int | None:
        return None if self.total is None else max(0, self.total - self.offset - min(self.size, max(0, self.total - self.offset)))

    def list(self) -> list[Row]:
        return self.df.collect()  # a page, of bounded size


@dataclass(frozen=True)
class Query:
    collection: Collection
    where_: fl.Filter | None = None
    sorts: tuple[Sort, ...] = ()
    offset_: int = 0
    limit_: int | None = None
    page_size_: int = PAGE
    with_total: bool = False
    scored_: bool = False
    scoring: str = "overlap"
    min_score_: float | None = None
    facets_: tuple = ()
    hits_: tuple = ()

    # building

    def filter(self, *filters: fl.Filter | Column | Callable[[Any], fl.Filter]) -> Query:
        """Rows must pass all filters, those given before included."""
        out = self
        for f in filters:
            f = fl.Expression(f) if isinstance(f, Column) else f(self.collection.model) if callable(f) and not isinstance(f, fl.Filter) else f
            out = replace(out, where_=f if out.where_ is None else fl.every(out.where_, f))
        return out

    def filter_option(self, f: fl.Filter | None) -> Query:
        return self if f is None else self.filter(f)

    def clear_filters(self) -> Query:
        return replace(self, where_=None)

    def sort(self, *sorts: Sort) -> Query:
        return replace(self, sorts=self.sorts + sorts)

    def clear_sort(self) -> Query:
        return replace(self, sorts=())

    def offset(self, n: int) -> Query:
        return replace(self, offset_=n)

    def limit(self, n: int | None) -> Query:
        return replace(self, limit_=n)

    def page_size(self, n: int) -> Query:
        return replace(self, page_size_=n)

    def page(self, n: int) -> Query:
        return self.offset(n * self.page_size_).limit(self.page_size_)

    def count_total(self, on: bool = True) -> Query:
        return replace(self, with_total=on)

    def scored(self, how: str = "overlap") -> Query:
        return replace(self, scored_=True, scoring=how)

    def min_score(self, x: float) -> Query:
        return replace(self, scored_=True, min_score_=x)

    def facet(self, field: Field | str, path: Sequence[str] = (), children_limit: int | None = 10, dim_limit: int | None = None) -> Query:
        from .operators.facets import FacetRequest

        name = field if isinstance(field, str) else field.name
        return replace(self, facets_=(*self.facets_, FacetRequest(name, tuple(path), children_limit if dim_limit is None else dim_limit)))

    def with_inner_hits(self, relation: fl.ExistsChild, size: int = 3, order: Sequence[Column] = (), name: str = "inner_hits", highlight: tuple[str, str] | None = None) -> Query:
        """For each row also its first children that pass the relation's filter."""
        return replace(self, hits_=(*self.hits_, (relation, size, tuple(order), name, highlight)))

    # the plan

    @property
    def scope(self) -> fl.Scope:
        kinds = {f.name: f.dataType for f in self.collection.df.schema.fields}

        def get(name: str) -> Column:
            return F.col(".".join(f"`{p}`" for p in name.split(".")))

        return fl.Scope(get, lambda n: fl._path_type(kinds, n))

    def _matching(self) -> DataFrame:
        """All rows that pass the filter, with a score column if one is asked for."""
        df, f = self.collection.df, self.where_
        if f is not None:
            self.collection.model.check(names_of(f))
            scope = self.scope
            plain, large = [], []
            for c in fl.conjuncts(f):
                if isinstance(c, fl.ExistsChild):
                    df = df.join(c.keys().withColumnRenamed("key", k := f"key_{uuid.uuid4().hex}"), F.col(c.key) == F.col(k), "left_semi")
                elif isinstance(c, fl.In) and len(c.values) >= fl.LARGE_IN and not scope.is_array(c.field):
                    large.append(c)
                else:
                    plain.append(c)
            flags: dict[fl.ExistsChild, str] = {}
            for c in plain:
                for x in fl.child_filters(c):
                    if x not in flags:
                        flags[x] = f"exists_{uuid.uuid4().hex}"
                        keys = x.keys().distinct().withColumnRenamed("key", k := f"key_{uuid.uuid4().hex}").withColumn(flags[x], F.lit(True))
                        df = df.join(keys, F.col(x.key) == F.col(k), "left").drop(k)
            scope = replace(scope, flags=flags)
            for c in plain:
                df = df.where(c.column(scope))
            for c in large:
                values = self.collection.spark.createDataFrame([(v,) for v in c.values if v is not None], T.StructType([T.StructField(k := f"value_{uuid.uuid4().hex}", scope.kind(c.field))]))
                df = df.join(values, F.col(c.field) == F.col(k), "left_semi")
            df = df.drop(*flags.values())
        if self.scored_ or any(s.best for s in self.sorts):
            df = self._with_score(df)
        if self.min_score_ is not None:
            df = df.where(F.col("_score") >= self.min_score_)
        return df

    def _with_score(self, df: DataFrame) -> DataFrame:
        f = self.where_
        if f is None:
            return df.withColumn("_score", F.lit(0.0))
        if self.scoring == "bm25":
            key, model, out = self.collection.model.key, self.collection.model, df
            total = F.lit(0.0)
            for i, (t, boost) in enumerate(token_clauses(f)):
                scores = tx.bm25(self.collection.df, key, F.col(t.field), tx.query_tokens(t.text, t.kind), f"_s{i}", t.kind).withColumnRenamed(key, f"_k{i}")
                out = out.join(scores, F.col(model.key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
                total = total + boost * F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
            return out.withColumn("_score", total).drop(*[f"_s{i}" for i in range(len(token_clauses(f)))])
        return df.withColumn("_score", f.score(replace(self.scope, flags={x: "" for x in ()})) if not fl.child_filters(f) else F.lit(1.0))

    def _order(self) -> list[Column]:
        out = []
        for s in self.sorts:
            if s.best:
                c = F.col("_score")
            elif s.vector is not None:
                c = vx.distance(F.col(s.field), vx.vector(list(s.vector)), s.metric)
            elif s.center is not None:
                out.append(fl.nearest(self.scope, s.field, s.center).asc_nulls_last())
                continue
            elif s.field is None:
                c = F.col(self.collection.model.key)
            else:
                c = self.scope.get(s.field)
            out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
        key = self.collection.model.key
        return [*out, F.col(key).asc()] if key in self.collection.df.columns else out

    def _sorted(self, df: DataFrame) -> DataFrame:
        if self.sorts or self.offset_ or self.limit_ is not None:
            df = df.orderBy(*self._order())
        if self.offset_:
            df = df.offset(self.offset_)
        return df if self.limit_ is None else df.limit(self.limit_)

    def _with_hits(self, df: DataFrame) -> DataFrame:
        for relation, size, order, name, mark in self.hits_:
            own = relation.children.query().filter(relation.filter).df
            if mark:
                own = own.withColumn("_highlight", tx.highlight(F.col(mark[0]), tx.query_tokens(mark[1])))
            from pyspark.sql import Window

            w = Window.partitionBy(relation.foreign_key).orderBy(*(order or [F.col(relation.children.model.key)]))
            top = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
            hits = top.groupBy(F.col(relation.foreign_key).alias("_parent")).agg(F.sort_array(F.collect_list(F.struct("_n", *[c for c in own.columns]))).alias(name))
            df = df.join(hits, F.col(relation.key) == F.col("_parent"), "left").drop("_parent")
        return df

    @property
    def df(self) -> DataFrame:
        """All matches (offset and limit applied, no page): the documents."""
        return self._with_hits(self._sorted(self._matching()))

    @property
    def docs(self) -> DataFrame:
        return self.df

    # projections

    def value(self, field: Field | str) -> DataFrame:
        return self.df.select(field if isinstance(field, str) else field.name)

    def id(self) -> DataFrame:
        return self.value(self.collection.model.key)

    def json(self, *fields: Field | str) -> DataFrame:
        names = [f if isinstance(f, str) else f.name for f in fields] or self.collection.df.columns
        return self.df.select(F.to_json(F.struct(*names)).alias("json"))

    def materialized(self, *fields: Field | str) -> DataFrame:
        return self.df.select(*[f if isinstance(f, str) else f.name for f in fields])

    def indexes(self) -> DataFrame:
        return self.materialized(*[n for n in self.collection.model.indexed if n in self.collection.df.columns])

    def doc_and_indexes(self) -> DataFrame:
        own = [n for n in self.collection.model.indexed if n in self.collection.df.columns]
        return self.df.select(F.struct(*self.collection.df.columns).alias("doc"), *own)

    def converted(self, f: Callable[[DataFrame], DataFrame] | Column, schema: str | None = None) -> DataFrame:
        """A column expression's values, or a function of batches of rows (pandas) with its schema."""
        return self.df.select(f) if isinstance(f, Column) else self.df.mapInPandas(f, schema)

    def distance(self, field: Field | str, center: g.Geo, sort: bool = True, radius: float | None = None) -> DataFrame:
        """Documents with ``distance``: metres to each geometry (an array)."""
        name = field if isinstance(field, str) else field.name
        q = self if radius is None else self.filter(fl.Within(name, center, radius))
        q = q.sort(Sort(field=name, center=center)) if sort else q
        kind = self.scope.kind(name)
        c = F.col(name)
        each = g.distances(c, center) if isinstance(kind, T.ArrayType) else F.array(fl.nearest(self.scope, name, center))
        return q.df.withColumn("distance", each)

    def highlighted(self, field: Field | str, text: str, name: str = "highlight") -> DataFrame:
        return self.df.withColumn(name, tx.highlight(F.col(field if isinstance(field, str) else field.name), tx.query_tokens(text)))

    # running

    def search(self) -> SearchResults:
        """One page: ``limit`` rows, or a page's size."""
        from .operators.facets import compute

        size = self.page_size_ if self.limit_ is None else self.limit_
        matching = self._matching()
        several = self.with_total or self.facets_
        if several:
            matching = matching.cache()  # page, total and facets read the same matches
        total = matching.count() if self.with_total else None
        facets = {r.name: compute(matching, r) for r in self.facets_}
        if several:
            matching.unpersist()
        return SearchResults(replace(self, limit_=size)._with_hits(replace(self, limit_=size)._sorted(matching)), self.offset_, total, facets, size)

    def stream(self) -> Iterator[Row]:
        """All matches, a partition at a time."""
        return self.df.toLocalIterator()

    def list(self) -> list[Row]:
        return self.search().list()

    def first(self) -> Row | None:
        return self.limit(1).df.first()

    def count(self) -> int:
        return self._sorted(self._matching()).count() if self.offset_ or self.limit_ is not None else self._matching().count()

    def distinct(self, field: Field | str) -> DataFrame:
        """Different values, nulls left out; sort and limit don't apply, elements of arrays count one by one."""
        name = field if isinstance(field, str) else field.name
        c = F.explode(name) if self.scope.is_array(name) else F.col(name)
        return self._matching().select(c.alias(name.split(".")[-1])).where(F.col(name.split(".")[-1]).isNotNull()).distinct()

    def after(self, field: Field | str, value: Any, key: Any, descending: bool = False, size: int | None = None) -> DataFrame:
        """The page that follows (value, key) in the order of a field: the previous page's last row."""
        name, own = field if isinstance(field, str) else field.name, self.collection.model.key
        past = F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value)
        q = self.filter(past | ((F.col(name) == F.lit(value)) & (F.col(own) > F.lit(key))))
        return q.clear_sort().sort(Sort(field=name, descending=descending)).limit(size or self.page_size_).df

    def grouped(self, field: Field | str, descending: bool = False) -> DataFrame:
        """(key, docs) in the order of the key, the documents by id."""
        name = field if isinstance(field, str) else field.name
        df = self._matching()
        docs = F.sort_array(F.collect_list(F.struct(self.collection.model.key, *[c for c in df.columns if c != self.collection.model.key])))
        return df.groupBy(F.col(name).alias("key")).agg(docs.alias("docs")).orderBy(F.col("key").desc() if descending else F.col("key").asc())

    def aggregate(self, *functions: Any) -> Any:
        from .aggregate import AggregateQuery

        return AggregateQuery(self, tuple(functions))

    def group_by(self, field: Field | str, **how: Any) -> DataFrame:
        from .operators.grouping import top_docs

        return top_docs(self._matching(), field if isinstance(field, str) else field.name, self.collection.model.key, **how)

    def composite_group_by(self, field: Field | str, page_size: int = PAGE, after: Any = None) -> DataFrame:
        from .operators.grouping import composite

        return composite(self._matching(), field if isinstance(field, str) else field.name, page_size, after)

    # writing, through the collection

    def delete(self) -> DataFrame:
        """The collection without the matches."""
        key = self.collection.model.key
        gone = self.df.select(F.col(key).alias("_gone"))
        return self.collection.stored.join(gone, F.col(key) == F.col("_gone"), "left_anti")

    def update(self, **values: Any) -> DataFrame:
        """The collection with the matches' fields set."""
        base, key = self.collection.stored, self.collection.model.key
        cast = {n: (v if isinstance(v, Column) else F.lit(v)).cast(base.schema[n].dataType) for n, v in values.items()}
        if self.offset_ == 0 and self.limit_ is None and self.where_ is not None and not fl.child_filters(self.where_) and self.min_score_ is None:
            hit = F.coalesce(self.where_.column(self.scope), F.lit(False))
            wide = self.collection.df.select("*", hit.alias("_hit"))
            return wide.select(*[(F.when(F.col("_hit"), cast[c]).otherwise(F.col(c)) if c in cast else F.col(c)).alias(c) for c in base.columns])
        hits = self.df.select(F.col(key).alias("_k")).withColumn("_hit", F.lit(True))
        joined = base.join(hits, F.col(key) == F.col("_k"), "left")
        return joined.select(*[(F.when(F.col("_hit"), cast[c]).otherwise(F.col(c)) if c in cast else F.col(c)).alias(c) for c in base.columns])

    def process(self, f: Callable) -> DataFrame:
        """Matches mapped by a function of pandas batches (rows it leaves out are deleted), the rest as it is."""
        changed = self.df.select(*self.collection.stored.columns).mapInPandas(f, self.collection.stored.schema)
        return self.delete().unionByName(changed)


def names_of(f: fl.Filter) -> set[str]:
    if isinstance(f, fl.Multi):
        return {n for c in f.clauses for n in names_of(c.filter)}
    return {f.field} if hasattr(f, "field") else {f.path} if isinstance(f, fl.Nested) else set()


def token_clauses(f: fl.Filter, boost: float = 1.0) -> list[tuple[fl.Tokens, float]]:
    if isinstance(f, fl.Tokens):
        return [] if f.negated else [(f, boost)]
    if isinstance(f, fl.Multi):
        return [x for c in f.clauses if c.condition in ("must", "should") for x in token_clauses(c.filter, boost * c.boost)]
    return []
