"""Aggregates, grouping, facets and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as fc
from ..operators.grouping import top_docs
from ..operators.pipeline import Accumulator, Pipeline
from ..tables import customers, lineitems, orders, table


def _sub(spark, d):
    c = customers(spark, d)
    m = c.model
    nested = c.query().aggregate(m.c_nationkey.group().as_("nation").with_sub_aggregates(m.c_mktsegment.group().as_("segment"), m.c_custkey.count().as_("n")), m.c_custkey.count().as_("total")).nested()
    return nested.select("nation", "total", F.explode("nationBuckets").alias("b")).select("nation", "total", "b.segment", "b.n")


def _grouped(spark, d):
    c = customers(spark, d)
    return c.query().filter(c.model.c_acctbal > 9900.0).grouped(c.model.c_mktsegment).select("key", F.explode("docs").alias("doc")).select("key", F.col("doc.c_custkey").alias("c_custkey"))


def _top_docs(spark, d):
    o = orders(spark, d)
    out = o.query().group_by(o.model.o_orderpriority, docs_per_group=3, within=[F.desc("o_totalprice")], group_limit=4, include_total=True)
    return out.select("o_orderpriority", "o_orderkey", "doc_rank", "group_rank", "total_groups")


def _facet_docs(spark, d):
    """Orders with a hierarchical facet of their date, and customers' nations with their regions."""
    o = orders(spark, d)
    date = F.array(F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))
    # some orders' path ends at the year
    path = F.when(F.col("o_orderkey") % 7 == 0, F.slice(date, 1, 1)).otherwise(date)
    o.stored = o.stored.withColumn("date", F.array(path))
    return o


def _facet2(spark, d):
    p = Pipeline(table(spark, d, "customer")).facet2(lambda x: x.group_by(["c_mktsegment"], n=F.count("*")), lambda x: x.group_by(["c_nationkey"], n=F.count("*")), ("segments", "nations"))
    return p.df.select(F.size("segments").cast("long").alias("segments"), F.size("nations").cast("long").alias("nations"), F.aggregate("nations", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"))


QUERIES = {
    "agg_global": lambda s, d: (o := orders(s, d)).query().aggregate(o.model.o_totalprice.max().as_("hi"), o.model.o_totalprice.min().as_("lo"), o.model.o_orderkey.count().as_("n"), o.model.o_custkey.count_distinct().as_("customers")).df,
    "agg_avg_sum": lambda s, d: (m := lineitems(s, d)).query().aggregate(m.model.l_returnflag.group().as_("flag"), m.model.l_quantity.avg().as_("mean"), m.model.l_quantity.sum().as_("total")).df.select("flag", F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total")),
    "agg_group_having_sort": lambda s, d: (o := orders(s, d)).query().aggregate(g := o.model.o_custkey.group().as_("customer"), n := o.model.o_orderkey.count().as_("n")).filter(n >= 15).sort(n.desc()).limit(50).df,
    "agg_composite_group": lambda s, d: (o := orders(s, d)).query().aggregate(o.model.o_orderstatus.group().as_("status"), o.model.o_orderpriority.group().as_("priority"), o.model.o_orderkey.count().as_("n")).df,
    "agg_count_distinct": lambda s, d: (m := lineitems(s, d)).query().aggregate(m.model.l_returnflag.group().as_("flag"), m.model.l_partkey.count_distinct().as_("parts")).df,
    "agg_empty_global": lambda s, d: (c := customers(s, d)).query().filter(c.model.c_custkey < 0).aggregate(c.model.c_acctbal.sum().as_("total"), c.model.c_custkey.count().as_("n")).df,
    "agg_concat": lambda s, d: (c := customers(s, d)).query().filter(c.model.c_acctbal > 9800.0).aggregate(c.model.c_mktsegment.group().as_("segment"), c.model.c_name.concat().as_("names")).df.select("segment", F.array_join("names", ";;").alias("names")),
    "agg_concat_distinct": lambda s, d: (c := customers(s, d)).query().aggregate(c.model.c_nationkey.group().as_("nation"), c.model.c_mktsegment.concat_distinct().as_("segments")).df.select("nation", F.array_join("segments", ";;").alias("segments")),
    "agg_having_text": lambda s, d: (o := orders(s, d)).query().aggregate(g := o.model.o_orderpriority.group().as_("priority"), o.model.o_orderkey.count().as_("n")).filter(g.regex("^[123]")).df,
    "agg_top_n_buckets": lambda s, d: (o := orders(s, d)).query().aggregate(o.model.o_custkey.group().as_("customer"), t := o.model.o_totalprice.max().as_("dearest")).sort(t.desc()).limit(10).df,
    "agg_count_rows": lambda s, d: (o := orders(s, d)).query().aggregate(o.model.o_custkey.group().as_("customer")).df.agg(F.count("*").alias("buckets")),
    "agg_sub_aggregates": _sub,
    "grouped_docs": _grouped,
    "grouped_docs_topn": _top_docs,
    "grouped_docs_all": lambda s, d: top_docs(table(s, d, "orders"), "o_custkey", "o_orderkey", 2, within=[F.desc("o_totalprice")]).select("o_custkey", "o_orderkey", "doc_rank", "group_rank"),
    "group_composite_page": lambda s, d: (o := orders(s, d)).query().composite_group_by(o.model.o_custkey, page_size=20, after=100),
    "facet_flat": lambda s, d: fc.top(customers(s, d).df, "c_mktsegment", limit=3),
    "facet_multi_valued": lambda s, d: fc.top(table(s, d, "part").withColumn("words", F.split("p_name", " ")), "words", limit=10),
    "facet_hier_root": lambda s, d: fc.top(_facet_docs(s, d).df, "date", limit=None),
    "facet_hier_path": lambda s, d: fc.top(_facet_docs(s, d).df, "date", ("1996",), limit=12),
    "facet_child_total_counts": lambda s, d: fc.totals(_facet_docs(s, d).df, "date", ("1996",), limit=5),
    "facet_drilldown": lambda s, d: (o := _facet_docs(s, d)).query().filter(o.model.field("date").drill_down("1996", "3")).df.select("o_orderkey"),
    "facet_only_this_level": lambda s, d: (o := _facet_docs(s, d)).query().filter(o.model.field("date").drill_down("1996", only_this_level=True)).df.select("o_orderkey"),
    "lookup_one": lambda s, d: Pipeline(table(s, d, "orders")).lookup_one(table(s, d, "customer"), "o_custkey", "c_custkey", "customer").df.select("o_orderkey", F.col("customer.c_name").alias("c_name")),
    "lookup_many_counts": lambda s, d: Pipeline(table(s, d, "customer")).lookup_many(table(s, d, "orders"), "c_custkey", "o_custkey", "orders").df.select("c_custkey", F.size("orders").cast("long").alias("n")),
    "pipeline_unwind_group": lambda s, d: Pipeline(table(s, d, "part")).unwind(F.split("p_name", " "), "word").group_by(["word"], n=F.count("*"), dearest=F.max("p_retailprice")).match(F.col("n") > 5).df,
    "pipeline_group3": lambda s, d: Pipeline(table(s, d, "lineitem")).group_by(["l_returnflag", "l_linestatus"], n=F.count("*"), most=F.max("l_quantity"), orders=F.count_distinct("l_orderkey")).df,
    "pipeline_accumulator": lambda s, d: Pipeline(table(s, d, "customer")).group_by(["c_mktsegment"], odd=Accumulator(F.col("c_custkey"), F.lit(0).cast("long"), lambda a, x: a + x % 2)).df,
    "pipeline_reduce_count": lambda s, d: Pipeline(table(s, d, "orders")).match(F.col("o_orderstatus") == "F").reduce(n=F.count("*"), dearest=F.max("o_totalprice")).df,
    "pipeline_sort_page": lambda s, d: Pipeline(table(s, d, "orders")).sort_page(F.desc("o_totalprice"), "o_orderkey", offset=10, limit=15).project("o_orderkey").df,
    "pipeline_facet2": _facet2,
    "facet_top": lambda s, d: Pipeline(table(s, d, "orders")).facet_top("o_custkey", 12).df,
}

_DATES = "f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN [year(o_orderdate)::VARCHAR] ELSE [year(o_orderdate)::VARCHAR, month(o_orderdate)::VARCHAR, day(o_orderdate)::VARCHAR] END AS p FROM orders)"

ORACLES = {
    "agg_global": "SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(o_orderkey) AS n, count(DISTINCT o_custkey) AS customers FROM orders",
    "agg_avg_sum": "SELECT l_returnflag AS flag, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1",
    "agg_group_having_sort": "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15 ORDER BY 2 DESC, 1 LIMIT 50",
    "agg_composite_group": "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2",
    "agg_count_distinct": "SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    "agg_empty_global": "SELECT sum(c_acctbal) AS total, count(c_custkey) AS n FROM customer WHERE c_custkey < 0",
    "agg_concat": "SELECT c_mktsegment AS segment, string_agg(c_name, ';;' ORDER BY c_custkey) AS names FROM customer WHERE c_acctbal > 9800 GROUP BY 1",
    "agg_concat_distinct": "SELECT c_nationkey AS nation, string_agg(DISTINCT c_mktsegment, ';;' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1",
    "agg_having_text": "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 HAVING regexp_matches(o_orderpriority, '^[123]')",
    "agg_top_n_buckets": "SELECT o_custkey AS customer, max(o_totalprice) AS dearest FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "agg_count_rows": "SELECT count(DISTINCT o_custkey) AS buckets FROM orders",
    "agg_sub_aggregates": "SELECT c_nationkey AS nation, sum(count(*)) OVER (PARTITION BY c_nationkey)::BIGINT AS total, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 3",
    "grouped_docs": "SELECT c_mktsegment AS key, c_custkey FROM customer WHERE c_acctbal > 9900",
    "grouped_docs_all": "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS doc_rank, dense_rank() OVER (ORDER BY o_custkey) AS group_rank FROM orders) SELECT o_custkey, o_orderkey, doc_rank::INT AS doc_rank, group_rank::BIGINT AS group_rank FROM r WHERE doc_rank <= 2",
    "grouped_docs_topn": "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS doc_rank, dense_rank() OVER (ORDER BY o_orderpriority) AS group_rank FROM orders) SELECT o_orderpriority, o_orderkey, doc_rank::INT AS doc_rank, group_rank::INT AS group_rank, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS total_groups FROM r WHERE doc_rank <= 3 AND group_rank <= 4",
    "group_composite_page": "SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey > 100 GROUP BY 1 ORDER BY 1 LIMIT 20",
    "facet_flat": "SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "facet_multi_valued": "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS label FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "facet_hier_root": f"WITH {_DATES} SELECT p[1] AS label, count(*) AS n FROM f GROUP BY 1",
    "facet_hier_path": f"WITH {_DATES} SELECT p[2] AS label, count(*) AS n FROM f WHERE p[1] = '1996' AND len(p) > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "facet_child_total_counts": f"WITH {_DATES}, c AS (SELECT CASE WHEN len(p) > 1 THEN p[2] ELSE '$ROOT$' END AS label, count(*) AS n FROM f WHERE p[1] = '1996' GROUP BY 1) SELECT (SELECT count(*) FROM c) AS child_count, (SELECT sum(n) FROM (SELECT n FROM c WHERE label <> '$ROOT$' ORDER BY n DESC, label LIMIT 5))::BIGINT AS total_count",
    "facet_drilldown": f"WITH {_DATES} SELECT o_orderkey FROM f WHERE p[1:2] = ['1996', '3']",
    "facet_only_this_level": f"WITH {_DATES} SELECT o_orderkey FROM f WHERE p = ['1996']",
    "lookup_one": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "lookup_many_counts": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "pipeline_unwind_group": "SELECT word, count(*) AS n, max(p_retailprice) AS dearest FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_retailprice FROM part) GROUP BY 1 HAVING count(*) > 5",
    "pipeline_group3": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2",
    "pipeline_accumulator": "SELECT c_mktsegment, sum(c_custkey % 2)::BIGINT AS odd FROM customer GROUP BY 1",
    "pipeline_reduce_count": "SELECT count(*) AS n, max(o_totalprice) AS dearest FROM orders WHERE o_orderstatus = 'F'",
    "pipeline_sort_page": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 10",
    "pipeline_facet2": "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations, count(*) AS total FROM customer",
    "facet_top": "SELECT o_custkey AS key, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
}
