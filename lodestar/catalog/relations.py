"""Views, SQL, set operations, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..collection import Database
from ..functions import values as v
from ..model import Model
from ..operators import graph
from ..plans import sqlapi as q
from ..plans.relation import Scan
from ..plans.views import Materialization, View
from ..sources import files
from ..tables import customers, table


def scan(spark, d, name, alias=None):
    return Scan(name, lambda: table(spark, d, name), alias)


def _tables(spark, d):
    return {n: table(spark, d, n) for n in ("customer", "orders", "nation", "region", "lineitem", "supplier")}


def _sql(text, *positional, **named):
    return lambda s, d: q.run(s, text, *positional, tables=_tables(s, d), **named)


def _select(build):
    def run(spark, d):
        for name, df in _tables(spark, d).items():
            df.createOrReplaceTempView(name)
        return build().run(spark)

    return run


def _counts(s, d):
    """Orders per customer; customers without any are kept by an outer join."""
    j = scan(s, d, "customer", "c").left_join(scan(s, d, "orders", "o"), F.col("c.c_custkey") == F.col("o.o_custkey"), where=F.col("o.o_orderstatus") == "F")
    n = F.count("o.o_orderkey")
    return j.group_by(F.col("c.c_custkey")).select(c_custkey=F.col("c.c_custkey"), n=n, load=v.case((n >= 5, F.lit("loaded")), otherwise=F.lit("light"))).df()


def _derived(s, d):
    top = scan(s, d, "orders", "o").group_by(F.col("o.o_custkey")).select(customer=F.col("o.o_custkey"), dearest=F.max("o.o_totalprice")).as_("t")
    return scan(s, d, "customer", "c").join(top, F.col("c.c_custkey") == F.col("t.customer")).select(c_name=F.col("c.c_name"), dearest=F.col("t.dearest")).df()


def _union(s, d):
    a = scan(s, d, "customer", "c").select(name=F.col("c.c_name"), nation=F.col("c.c_nationkey"))
    b = scan(s, d, "supplier", "p").select(name=F.col("p.s_name"), nation=F.col("p.s_nationkey"))
    return a.union_all(b).df()


def _theta(s, d):
    a, b = scan(s, d, "nation", "a"), scan(s, d, "nation", "b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(first=F.col("a.n_name"), second=F.col("b.n_name")).df()


def _folder(spark):
    return graph.shared_folder(spark)


def _kept_view(s, d):
    view = View("kept", scan(s, d, "customer", "c").where(F.col("c.c_acctbal") > 5000.0).select(c_custkey=F.col("c.c_custkey"), segment=F.col("c.c_mktsegment")), s, _folder(s), Materialization("cached"))
    view.rebuild()
    return view.df


def _scoped(s, d):
    """A view by segment after two segments' customers changed and only they were refreshed."""
    c = customers(s, d)
    rows = {"df": c.stored.where("c_nationkey < 20")}
    view = View("scoped", Scan("customer", lambda: rows["df"]).group_by(F.col("c_mktsegment")).select(segment=F.col("c_mktsegment"), n=F.count("*"), most=F.max("c_acctbal")), s, _folder(s), Materialization("cached"), scope="segment")
    view.rebuild()
    rows["df"] = c.stored
    view.refresh(["BUILDING", "MACHINERY"])
    return view.df.select("segment", "n", "most")


def _upsert(s, d):
    c = customers(s, d)
    with c.transaction() as t:
        t.upsert(c.stored.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(c.stored.where("c_custkey < 5").withColumns({"c_custkey": F.col("c_custkey") + 10_000_000, "c_name": F.lit("new")})))
    return c.stored.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def _update(s, d):
    c = customers(s, d)
    with c.transaction() as t:
        t.update_where(c.model.c_nationkey == 3, c_mktsegment="MOVED", c_acctbal=F.lit(1.5))
    return c.stored.select("c_custkey", "c_mktsegment")


def _delete(s, d):
    c = customers(s, d)
    with c.transaction() as t:
        t.delete_where((c.model.c_acctbal < 0.0) | (c.model.c_mktsegment == "BUILDING"))
    return c.stored.select("c_custkey")


def _delete_limited(s, d):
    c = customers(s, d)
    with c.transaction() as t:
        t.delete_where(c.model.c_mktsegment == "BUILDING", limit=10)
    return c.stored.select("c_custkey")


def _insert_roundtrip(s, d):
    db = Database(s, _folder(s))
    df = table(s, d, "supplier")
    db.collection(Model.of("supplier", df, key="s_suppkey"), df)
    folder = f"{_folder(s)}/backup-{id(db)}"
    files.backup(db, folder)
    with db.collections["supplier"].transaction() as t:
        t.truncate()
    files.restore(db, folder)
    return db.collections["supplier"].stored.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


def _csv_roundtrip(s, d):
    path = f"{_folder(s)}/csv-{id(d)}"
    df = table(s, d, "nation")
    df.write.mode("overwrite").csv(path, header=True)
    return files.csv(s, path, df.schema)


def _dynamic(s, d):
    kv = files.key_values(table(s, d, "supplier"), "s_suppkey")
    return kv.select("_id", v.json_field(F.col("json"), "s_nationkey", "int").alias("nation")).where("nation < 5")


QUERIES = {
    "view_filter_project": lambda s, d: scan(s, d, "customer", "c").where(F.col("c.c_acctbal") >= 5000.0).select(id=F.col("c.c_custkey"), name=F.col("c.c_name")).df(),
    "view_inner_join": lambda s, d: scan(s, d, "orders", "o").join(scan(s, d, "customer", "c"), F.col("o.o_custkey") == F.col("c.c_custkey")).where(F.col("c.c_mktsegment") == "BUILDING").select(order=F.col("o.o_orderkey"), name=F.col("c.c_name")).df(),
    "view_left_join_case": _counts,
    "view_derived_join": _derived,
    "view_union_all": _union,
    "view_concat_id": lambda s, d: scan(s, d, "customer", "c").select(id=v.concat(F.col("c.c_custkey"), ":", F.nullif(F.col("c.c_mktsegment"), F.lit("BUILDING")))).df(),
    "view_theta_join": _theta,
    "view_kept": _kept_view,
    "view_scoped_refresh": _scoped,
    "sql_named_params": _sql("SELECT c_custkey FROM {customer} WHERE c_nationkey = :nation AND c_acctbal > :least", nation=5, least=100.0),
    "sql_positional_params": _sql("SELECT c_custkey FROM {customer} WHERE c_nationkey = ? OR c_nationkey = ?", 5, 6),
    "sql_joins": _sql("SELECT n_name, count(s_suppkey) AS suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name"),
    "sql_full_join": _select(lambda: q.select(q.call("coalesce", q.col("s_nationkey"), q.col("c_nationkey")).as_("nation"), q.count_all().as_("n")).from_("supplier").full_join("customer", q.raw("s_nationkey = c_nationkey AND s_suppkey = c_custkey")).group_by(q.raw("1"))),
    "sql_cross_join": _select(lambda: q.select(q.col("a.r_name").as_("one"), q.col("b.r_name").as_("other")).from_("region a").cross_join("region b")),
    "sql_exists_not_exists": _select(lambda: q.select("c_custkey").from_("customer c").where(q.exists(q.select(q.raw("1")).from_("orders o").where(q.raw("o.o_custkey = c.c_custkey"), q.col("o_totalprice").gt(300000.0))), q.exists(q.select(q.raw("1")).from_("orders o").where(q.raw("o.o_custkey = c.c_custkey"), q.col("o_orderstatus").eq("P")), negated=True))),
    "sql_in_subquery": _select(lambda: q.select("c_custkey").from_("customer").where(q.col("c_nationkey").is_in(q.select("n_nationkey").from_("nation").where(q.col("n_regionkey").eq(2))), q.col("c_custkey").is_in(q.select("o_custkey").from_("orders").where(q.col("o_totalprice").gt(250000.0)), negated=True))),
    "sql_correlated_scalar": _select(lambda: q.select("o_orderkey", q.scalar(q.select(q.raw("max(l_quantity)")).from_("lineitem l").where(q.raw("l.l_orderkey = o.o_orderkey"))).as_("most")).from_("orders o").where(q.col("o_orderstatus").eq("P"))),
    "sql_union_distinct": _select(lambda: q.select(q.col("c_nationkey").as_("nation")).from_("customer").union(q.select("s_nationkey").from_("supplier")).order_by(q.raw("nation")).limit(15).offset(5)),
    "sql_union_all": _select(lambda: q.select(q.col("c_nationkey").as_("nation")).from_("customer").union_all(q.select("s_nationkey").from_("supplier"))),
    "sql_group_having": _select(lambda: q.select("c_nationkey", q.raw("max(c_acctbal)").as_("most"), q.count_all().as_("n")).from_("customer").group_by(q.col("c_nationkey")).having(q.count_all().gt(5)).order_by(q.col("c_nationkey"))),
    "sql_coalesce_greatest_least": _select(lambda: q.select("c_custkey", q.coalesce(q.raw("nullif(c_mktsegment, 'BUILDING')"), "none").as_("segment"), q.greatest(q.col("c_nationkey"), 10).as_("hi"), q.least(q.col("c_nationkey"), 10).as_("lo"), q.case((q.col("c_acctbal").lt(0.0), "debt"), otherwise="fine").as_("state")).from_("customer")),
    "sql_like_null_cast": _select(lambda: q.select("c_custkey", q.cast(q.col("c_nationkey"), "STRING").as_("nation"), q.position(q.array(1, 2, 3), q.col("c_nationkey")).as_("place")).from_("customer").where(q.col("c_name").like("%1_"), q.typed_null("INT").is_null(), q.col("c_mktsegment").is_not_null())),
    "sql_json_array_contains": _select(lambda: q.select("c_custkey").from_("customer").where(q.array_contains(q.raw("concat('[', c_nationkey, ',42]')"), 7, "int"))),
    "sql_distinct": _select(lambda: q.select("o_orderstatus", "o_orderpriority").from_("orders").distinct()),
    "write_upsert_result": _upsert,
    "write_update_by_query": _update,
    "write_delete_by_query": _delete,
    "write_delete_limited": _delete_limited,
    "write_insert_json_roundtrip": _insert_roundtrip,
    "source_csv_roundtrip": _csv_roundtrip,
    "source_dynamic_json": _dynamic,
}

ORACLES = {
    "view_filter_project": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 5000",
    "view_inner_join": "SELECT o_orderkey AS \"order\", c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "view_left_join_case": "SELECT c_custkey, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) >= 5 THEN 'loaded' ELSE 'light' END AS load FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1",
    "view_derived_join": "SELECT c_name, dearest FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS dearest FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "view_union_all": "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
    "view_concat_id": "SELECT c_custkey || ':' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS id FROM customer",
    "view_theta_join": "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "view_kept": "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_acctbal > 5000",
    "view_scoped_refresh": "SELECT c_mktsegment AS segment, count(*) AS n, max(c_acctbal) AS most FROM customer WHERE c_nationkey < 20 OR c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "sql_named_params": "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal > 100",
    "sql_positional_params": "SELECT c_custkey FROM customer WHERE c_nationkey IN (5, 6)",
    "sql_joins": "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(*) AS n FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey GROUP BY 1",
    "sql_cross_join": "SELECT a.r_name AS one, b.r_name AS other FROM region a CROSS JOIN region b",
    "sql_exists_not_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')",
    "sql_in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "sql_correlated_scalar": "SELECT o_orderkey, (SELECT max(l_quantity) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS most FROM orders o WHERE o_orderstatus = 'P'",
    "sql_union_distinct": "SELECT nation FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) ORDER BY 1 LIMIT 15 OFFSET 5",
    "sql_union_all": "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "sql_group_having": "SELECT c_nationkey, max(c_acctbal) AS most, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 5",
    "sql_coalesce_greatest_least": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_nationkey, 10) AS hi, least(c_nationkey, 10) AS lo, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM customer",
    "sql_like_null_cast": "SELECT c_custkey, c_nationkey::VARCHAR AS nation, CASE WHEN c_nationkey BETWEEN 1 AND 3 THEN c_nationkey::BIGINT END AS place FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment IS NOT NULL",
    "sql_json_array_contains": "SELECT c_custkey FROM customer WHERE c_nationkey = 7",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "write_upsert_result": "SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END, 2) AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 'new', round(c_acctbal, 2) FROM customer WHERE c_custkey < 5",
    "write_update_by_query": "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "write_delete_by_query": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')",
    "write_delete_limited": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 10)",
    "write_insert_json_roundtrip": "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier",
    "source_csv_roundtrip": "SELECT * FROM nation",
    "source_dynamic_json": "SELECT s_suppkey::VARCHAR AS _id, s_nationkey AS nation FROM supplier WHERE s_nationkey < 5",
}
