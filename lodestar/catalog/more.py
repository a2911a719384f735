"""Registered functions, derived tables, partitions by key, paging through search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..collection import Database
from ..functions import registered
from ..model import Model
from ..operators import graph
from ..plans.materialized import Materialized
from ..tables import customers, orders, table


def _registered(s, d):
    registered.register(s)
    table(s, d, "customer").createOrReplaceTempView("customer")
    return s.sql("SELECT c_custkey FROM customer WHERE geo_within(c_custkey * 37 % 160 - 80, c_custkey * 91 % 340 - 170, 10, 20, 3000000) AND in_box(c_custkey * 37 % 160 - 80, 0, -40, -1, 60, 1) AND finds(c_name, '[0-5]$')")


def _vectors(s, d):
    registered.register(s)
    table(s, d, "embeddings").createOrReplaceTempView("embeddings")
    return s.sql("SELECT a.vec_id, round(vector_cosine(cast(a.embedding AS ARRAY<DOUBLE>), cast(b.embedding AS ARRAY<DOUBLE>)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10")


def _materialized(s, d):
    """Customers per nation, followed through an update, a delete and an insert."""
    c = customers(s, d)
    m = Materialized(c, "nation", F.col("c_nationkey"), lambda df: df.groupBy("nation").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last")))
    with c.transaction() as t:
        t.update_where(c.model.c_custkey < 20, c_nationkey=24)
        t.delete(25, 26, 27)
        t.upsert(c.stored.where("c_custkey = 30").withColumn("c_custkey", F.lit(10_000_000).cast("long")))
    return m.rows


def _multi(s, d):
    """One collection kept in a folder per key; reading one key reads one folder."""
    db = Database(s, graph.shared_folder(s))
    df = table(s, d, "orders")
    db.collection(Model.of("orders", df, key="o_orderkey"), df)
    path = db.save("orders", partition_by=["o_orderstatus"])
    return s.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def _page(s, d):
    c = customers(s, d)
    page = c.query().filter(c.model.c_acctbal > 0.0).sort(c.model.c_name.desc()).page_size(25).offset(50).search()
    return page.df.select("c_custkey")


def _stream_rest(s, d):
    o = orders(s, d)
    return o.query().filter(o.model.o_orderstatus == "P").sort(o.model.o_orderdate.asc()).offset(5).df.select("o_orderkey")


def _limited_update(s, d):
    c = customers(s, d)
    return c.query().filter(c.model.c_mktsegment == "BUILDING").sort(c.model.c_acctbal.desc()).limit(7).update(c_mktsegment="TOP").select("c_custkey", "c_mktsegment")


def _process(s, d):
    """Debtors are dropped, others' balance doubled, by a function of batches."""
    c = customers(s, d)

    def step(batches):
        for b in batches:
            b = b[b["c_acctbal"] >= 0]
            yield b.assign(c_acctbal=b["c_acctbal"] * 2)

    with c.transaction() as t:
        t.process(c.model.c_nationkey == 6, step)
    return c.stored.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


QUERIES = {
    "sql_registered_functions": _registered,
    "sql_registered_vectors": _vectors,
    "materialized_model": _materialized,
    "multi_store": _multi,
    "search_page": _page,
    "stream_with_offset": _stream_rest,
    "write_limited_update": _limited_update,
    "write_process": _process,
}

ORACLES = {
    "sql_registered_functions": "WITH p AS (SELECT c_custkey, c_name, (c_custkey * 37 % 160 - 80)::DOUBLE AS lat, (c_custkey * 91 % 340 - 170)::DOUBLE AS lon FROM customer) SELECT c_custkey FROM p WHERE 2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))) <= 3000000 AND lat BETWEEN -40 AND 60 AND regexp_matches(c_name, '[0-5]$')",
    "sql_registered_vectors": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10",
    "materialized_model": "SELECT nation, count(*) AS n, max(k) AS last FROM (SELECT CASE WHEN c_custkey < 20 THEN 24 ELSE c_nationkey END AS nation, c_custkey AS k FROM customer WHERE c_custkey NOT IN (25, 26, 27) UNION ALL SELECT c_nationkey, 10000000 FROM customer WHERE c_custkey = 30) GROUP BY 1",
    "multi_store": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "search_page": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_name DESC, c_custkey LIMIT 25 OFFSET 50",
    "stream_with_offset": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey OFFSET 5",
    "write_limited_update": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 7) THEN 'TOP' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "write_process": "SELECT c_custkey, round(CASE WHEN c_nationkey = 6 THEN c_acctbal * 2 ELSE c_acctbal END, 2) AS c_acctbal FROM customer WHERE NOT (c_nationkey = 6 AND c_acctbal < 0)",
}
