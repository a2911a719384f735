"""Filters, projections, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import filters as fl
from ..tables import customers, customers_with_orders, documents, lineitems, orders, orders_with_items, parts, table


def _flagship(spark, d):
    c, o = customers(spark, d), orders(spark, d)
    building = c.query().filter(c.model.c_mktsegment == "BUILDING").df.select("c_custkey", "c_name")
    big = o.query().filter((o.model.o_orderstatus == "O") & (o.model.o_totalprice > 100000.0)).df
    return big.join(building, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("o_totalprice")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def _null_segment(spark, d):
    """Customers with the segment null where it is MACHINERY: the tables have no nulls."""
    c = customers(spark, d)
    c.stored = c.stored.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return c


def _ids(build, make=customers):
    def run(spark, d):
        c = make(spark, d)
        return c.query().filter(build(c.model)).df.select(c.model.key)

    return run


def _nested_must_not(m):
    return m.items.nested(lambda i: fl.Builder().must(i.flag == "R").must(i.quantity > 40.0).must_not(i.discount >= 0.09).build())


def _exists(build):
    def run(spark, d):
        c, o = customers(spark, d), orders(spark, d)
        return c.query().filter(build(c, o)).df.select("c_custkey")

    return run


def _keyset(spark, d):
    o = orders(spark, d)
    return o.query().after(o.model.o_totalprice, 100000.0, 500, size=50).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


def _json(spark, d):
    c = customers(spark, d)
    return c.query().filter(c.model.c_acctbal < 0.0).json("c_custkey", "c_name")


def _doc_and_index(spark, d):
    c = customers(spark, d)
    return c.query().filter(c.model.c_acctbal > 9000.0).doc_and_indexes().select(F.col("doc.c_name").alias("doc_name"), "c_custkey", "c_mktsegment")


QUERIES = {
    "flagship": _flagship,
    "filter_equals": _ids(lambda m: m.c_mktsegment == "BUILDING"),
    "filter_not_equals": lambda s, d: (c := _null_segment(s, d)).query().filter(c.model.c_mktsegment != "BUILDING").df.select("c_custkey"),
    "filter_is_null": lambda s, d: (c := _null_segment(s, d)).query().filter(c.model.c_mktsegment.is_null()).df.select("c_custkey"),
    "filter_is_not_null": lambda s, d: (c := _null_segment(s, d)).query().filter(c.model.c_mktsegment.is_not_null()).df.select("c_custkey"),
    "filter_range_strict": _ids(lambda m: (m.o_totalprice > 50000.0) & (m.o_totalprice < 60000.0), orders),
    "filter_between": _ids(lambda m: m.o_totalprice.between(100000.0, 120000.0), orders),
    "filter_in": _ids(lambda m: m.c_nationkey.is_in([1, 5, 9])),
    "filter_in_large": _ids(lambda m: m.c_custkey.is_in(range(0, 3000, 2))),
    "filter_timestamp_range": lambda s, d: (o := orders(s, d)).query().filter(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))).filter(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).df.select("o_orderkey"),
    "filter_starts_with": _ids(lambda m: m.c_name.starts_with("Customer#00000001")),
    "filter_ends_with": _ids(lambda m: m.c_name.ends_with("7")),
    "filter_contains": _ids(lambda m: m.c_name.contains("12")),
    "filter_contains_literal": _ids(lambda m: m.c_name.contains("_") | m.c_name.contains("%")),
    "filter_regex": _ids(lambda m: m.c_name.regex("0[13]5$")),
    "filter_exact": _ids(lambda m: m.c_mktsegment.exactly("HOUSEHOLD")),
    "filter_words": _ids(lambda m: m.p_name.words("an e", match_starts=True, match_ends=True), parts),
    "filter_multi_minshould2": _ids(lambda m: fl.Builder().min_should(2).should(m.c_mktsegment == "BUILDING").should(m.c_acctbal > 5000.0).should(m.c_nationkey < 10).build()),
    "filter_must_mustnot_should": _ids(lambda m: fl.Builder().must(m.c_acctbal > 0.0).must_not(m.c_nationkey == 3).should(m.c_mktsegment == "BUILDING").should(m.c_mktsegment == "FURNITURE").build()),
    "filter_filter_clause": _ids(lambda m: fl.Builder().filter(m.c_acctbal > 0.0).should(m.c_mktsegment == "BUILDING").build()),
    "filter_pure_mustnot": lambda s, d: (c := _null_segment(s, d)).query().filter(~(c.model.c_mktsegment == "BUILDING")).df.select("c_custkey"),
    "filter_algebra": _ids(lambda m: ((m.c_nationkey == 1) | (m.c_nationkey == 2)) & ((m.c_acctbal > 5000.0) | (m.c_mktsegment == "BUILDING"))),
    "filter_match_none": _ids(lambda m: fl.Nothing()),
    "filter_array_has_all": _ids(lambda m: m.words.has_all(["a", "b"]) | m.words.has("blue"), parts),
    "filter_array_has_any": _ids(lambda m: m.words.has_any(["red", "blue", "green"]), parts),
    "filter_optional": lambda s, d: (c := customers(s, d)).query().filter_option(None).filter_option(c.model.c_nationkey == 7).df.select("c_custkey"),
    "nested_same_element": _ids(lambda m: m.items.nested(lambda i: (i.flag == "R") & (i.quantity > 45.0)), orders_with_items),
    "nested_must_not": _ids(_nested_must_not, orders_with_items),
    "nested_in_nested": _ids(lambda m: m.orders.nested(lambda o: (o.status == "F") & o.items.nested(lambda i: (i.flag == "R") & (i.quantity >= 49.0))), customers_with_orders),
    "exists_child": _exists(lambda c, o: c.exists_child(o, "o_custkey", o.model.o_totalprice > 300000.0)),
    "child_same_all": _exists(lambda c, o: fl.same_child(o, "o_custkey", [o.model.o_orderstatus == "F", o.model.o_orderpriority == "1-URGENT"], "c_custkey")),
    "child_collective_all": _exists(lambda c, o: fl.collective(o, "o_custkey", [o.model.o_orderstatus == "F", o.model.o_orderpriority == "1-URGENT"], "c_custkey")),
    "child_any": _exists(lambda c, o: fl.same_child(o, "o_custkey", [], "c_custkey")),
    "anti_child": _exists(lambda c, o: ~c.exists_child(o, "o_custkey", o.model.o_totalprice > 200000.0)),
    "child_or_field": _exists(lambda c, o: c.exists_child(o, "o_custkey", o.model.o_totalprice > 400000.0) | (c.model.c_acctbal < 0.0)),
    "child_aggregate": lambda s, d: (c := customers(s, d), o := orders(s, d)) and c.query().filter(c.exists_child(o, "o_custkey", o.model.o_totalprice > 300000.0)).aggregate(c.model.c_mktsegment.group().as_("segment"), c.model.c_custkey.count().as_("n")).df,
    "project_json_fields": _json,
    "project_value_distinct": lambda s, d: (c := _null_segment(s, d)).query().distinct(c.model.c_mktsegment),
    "distinct_array_values": lambda s, d: (p := parts(s, d)).query().distinct(p.model.words),
    "project_doc_and_index": _doc_and_index,
    "project_converted": lambda s, d: (c := customers(s, d)).query().converted(F.upper("c_name").alias("upper_name")),
    "sort_multi_offset_limit": lambda s, d: (c := customers(s, d)).query().sort(c.model.c_nationkey.asc(), c.model.c_acctbal.desc()).offset(20).limit(30).df.select("c_custkey", "c_nationkey"),
    "sort_index_order": lambda s, d: (c := customers(s, d)).query().limit(25).df.select("c_custkey"),
    "keyset_page": _keyset,
    "topk_by_field": lambda s, d: (o := orders(s, d)).query().sort(o.model.o_totalprice.desc()).limit(10).df.select("o_orderkey"),
    "count_total": lambda s, d: (c := customers(s, d)).query().filter(c.model.c_acctbal > 0.0)._matching().agg(F.count("*").alias("total")),
    "get_by_id": lambda s, d: customers(s, d).get_all([3, 5, 7]).select("c_custkey", "c_name"),
    "prefix_scan": lambda s, d: (c := customers(s, d), setattr(c.model, "key", "c_name")) and c.prefix("Customer#00000002").select("c_name"),
    "inner_hits": lambda s, d: (c := customers(s, d), o := orders(s, d)) and c.query().filter(c.model.c_nationkey == 4).with_inner_hits(c.exists_child(o, "o_custkey", o.model.o_orderstatus == "F"), size=2, order=[F.desc("o_totalprice"), F.col("o_orderkey")]).df.select("c_custkey", F.explode("inner_hits").alias("h")).select("c_custkey", F.col("h.o_orderkey").alias("o_orderkey")),
    "bench_term": lambda s, d: (c := customers(s, d)).query().filter(c.model.c_name == "Customer#000000042")._matching().agg(F.count("*").alias("n")),
    "bench_range": lambda s, d: (m := lineitems(s, d)).query().filter(m.model.l_quantity.between(20.0, 30.0))._matching().agg(F.count("*").alias("n")),
    "bench_filter_sort_page": lambda s, d: (o := orders(s, d)).query().filter(o.model.o_totalprice.between(50000.0, 150000.0)).sort(o.model.o_orderpriority.asc()).limit(20).df.select("o_orderkey"),
    "bench_contains": lambda s, d: (x := documents(s, d)).query().filter(x.model.text.contains("tion the"))._matching().agg(F.count("*").alias("n")),
    "bench_full_scan": lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")),
}

_NULLED = "(SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer)"
_CHILD = "SELECT c_custkey FROM customer c WHERE {} (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {})"

ORACLES = {
    "flagship": "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY 3 DESC, 1 LIMIT 20",
    "filter_equals": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_not_equals": f"SELECT c_custkey FROM {_NULLED} WHERE seg IS DISTINCT FROM 'BUILDING'",
    "filter_is_null": f"SELECT c_custkey FROM {_NULLED} WHERE seg IS NULL",
    "filter_is_not_null": f"SELECT c_custkey FROM {_NULLED} WHERE seg IS NOT NULL",
    "filter_range_strict": "SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_totalprice < 60000",
    "filter_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9)",
    "filter_in_large": "SELECT c_custkey FROM customer WHERE c_custkey < 3000 AND c_custkey % 2 = 0",
    "filter_timestamp_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    "filter_starts_with": "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')",
    "filter_ends_with": "SELECT c_custkey FROM customer WHERE ends_with(c_name, '7')",
    "filter_contains": "SELECT c_custkey FROM customer WHERE contains(c_name, '12')",
    "filter_contains_literal": "SELECT c_custkey FROM customer WHERE contains(c_name, '_') OR contains(c_name, '%')",
    "filter_regex": "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[13]5$')",
    "filter_exact": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'",
    "filter_words": "SELECT p_partkey FROM part WHERE contains(p_name, 'an') AND contains(p_name, 'e')",
    "filter_multi_minshould2": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING')::INT + (c_acctbal > 5000)::INT + (c_nationkey < 10)::INT >= 2",
    "filter_must_mustnot_should": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3 AND c_mktsegment IN ('BUILDING', 'FURNITURE')",
    "filter_filter_clause": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'",
    "filter_pure_mustnot": f"SELECT c_custkey FROM {_NULLED} WHERE NOT coalesce(seg = 'BUILDING', false)",
    "filter_algebra": "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) AND (c_acctbal > 5000 OR c_mktsegment = 'BUILDING')",
    "filter_match_none": "SELECT c_custkey FROM customer WHERE false",
    "filter_array_has_all": "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['a', 'b']) OR list_contains(string_split(p_name, ' '), 'blue')",
    "filter_array_has_any": "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green'])",
    "filter_optional": "SELECT c_custkey FROM customer WHERE c_nationkey = 7",
    "nested_same_element": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)",
    "nested_must_not": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 40) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_discount >= 0.09)",
    "nested_in_nested": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F' AND l_returnflag = 'R' AND l_quantity >= 49)",
    "exists_child": _CHILD.format("EXISTS", "o_totalprice > 300000"),
    "child_same_all": _CHILD.format("EXISTS", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "child_collective_all": _CHILD.format("EXISTS", "o_orderstatus = 'F'") + " AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')",
    "child_any": _CHILD.format("EXISTS", "true"),
    "anti_child": _CHILD.format("NOT EXISTS", "o_totalprice > 200000"),
    "child_or_field": _CHILD.format("c_acctbal < 0 OR EXISTS", "o_totalprice > 400000"),
    "child_aggregate": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000) GROUP BY 1",
    "project_json_fields": """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS json FROM customer WHERE c_acctbal < 0""",
    "project_value_distinct": f"SELECT DISTINCT seg AS c_mktsegment FROM {_NULLED} WHERE seg IS NOT NULL",
    "distinct_array_values": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS words FROM part",
    "project_doc_and_index": "SELECT c_name AS doc_name, c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 9000",
    "project_converted": "SELECT upper(c_name) AS upper_name FROM customer",
    "sort_multi_offset_limit": "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 30 OFFSET 20",
    "sort_index_order": "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 25",
    "keyset_page": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE (o_totalprice, o_orderkey) > (100000, 500) ORDER BY o_totalprice, o_orderkey LIMIT 50",
    "topk_by_field": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "count_total": "SELECT count(*) AS total FROM customer WHERE c_acctbal > 0",
    "get_by_id": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 7)",
    "prefix_scan": "SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000002') ORDER BY 1",
    "inner_hits": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4 AND o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "bench_term": "SELECT count(*) AS n FROM customer WHERE c_name = 'Customer#000000042'",
    "bench_range": "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 20 AND 30",
    "bench_filter_sort_page": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000 ORDER BY o_orderpriority, o_orderkey LIMIT 20",
    "bench_contains": "SELECT count(*) AS n FROM documents WHERE contains(text, 'tion the')",
    "bench_full_scan": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem",
}
