"""Text, vectors, geometry, JSON, time, distance and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import filters as fl
from ..functions import distances as ds
from ..functions import geo as g
from ..functions import text as tx
from ..functions import timestamps as ts
from ..functions import values as v
from ..functions import vectors as vx
from ..model import Sort
from ..operators import graph
from ..operators.pipeline import Pipeline
from ..streaming import changes
from ..tables import EDGES, SQUARE, customers_with_places, documents, edges, embeddings, table

HOME = g.Geo.point(10.0, 20.0)
QUERY = [((i * 37) % 64 - 32) / 64 for i in range(64)]


def _overlap(s, d):
    x = documents(s, d)
    f = fl.Builder().should(x.model.text == "the of").should(x.model.text == "with", boost=2.0).build()
    return x.query().filter(f).scored().sort(Sort.best_match()).limit(30).df.select("doc_id", F.col("_score").alias("score"))


def _min_score(s, d):
    x = documents(s, d)
    f = fl.Builder().should(x.model.text == "the").should(x.model.text == "und", boost=3.0).should(x.model.text == "of").build()
    return x.query().filter(f).scored().min_score(2.0).df.select("doc_id", F.col("_score").alias("score"))


def _knn(metric, n=10, where=None):
    def run(s, d):
        x = embeddings(s, d)
        q = x.query() if where is None else x.query().filter(where(x.model))
        return q.sort(x.model.embedding.knn(QUERY, metric)).limit(n).df.select("vec_id")

    return run


def _geo_sorted(s, d):
    c = customers_with_places(s, d)
    return c.query().limit(25).distance(c.model.point, HOME, radius=5_000_000.0).select("c_custkey", F.round(F.element_at("distance", 1), 0).alias("meters"))


def _shortest(s, d):
    e = edges(s, d)
    start = e.groupBy("_from").count().orderBy(F.desc("count"), "_from").first()["_from"]
    far = graph.bfs(e, [start], 3).where("depth = 2").orderBy("node").first()
    if far is None:
        return s.createDataFrame([], "path string, length int")
    return graph.shortest_paths(e, start, far["node"], 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


def _seeds(s, d, n=5):
    e = edges(s, d)
    return e, e.groupBy(F.col("_from").alias("node")).count().orderBy(F.desc("count"), "node").limit(n).select("node")


def _all_paths(s, d):
    e = edges(s, d)
    start = e.groupBy("_from").count().orderBy(F.desc("count"), "_from").first()["_from"]
    far = graph.bfs(e, [start], 3).where("depth = 2").orderBy("node").first()
    if far is None:
        return s.createDataFrame([], "path string, length int")
    return graph.all_paths(e, start, far["node"], 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


def _follow(s, d):
    """From a nation's suppliers over their lines' orders to customers."""
    a = table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("_from"), F.col("s_suppkey").alias("_to"))
    b = table(s, d, "lineitem").select(F.col("l_suppkey").alias("_from"), F.col("l_orderkey").alias("_to"))
    c = table(s, d, "orders").select(F.col("o_orderkey").alias("_from"), F.col("o_custkey").alias("_to"))
    return graph.follow(s.createDataFrame([(3,)], "node long"), a, b, c)


def _graph_lookup(s, d):
    e, seeds = _seeds(s, d, 10)
    out = Pipeline(seeds).graph_lookup(e, "node", 2).df
    return out.select("node", F.size("reached").cast("long").alias("n"))


def _hop(s, d):
    e, seeds = _seeds(s, d, 10)
    return Pipeline(seeds).hop(e, table(s, d, "part"), "node", "p_partkey", 2).df.select("p_partkey", "p_name")


def _components(s, d):
    return graph.components(edges(s, d)).groupBy("component").agg(F.count("*").alias("n"))



def _time():
    return F.col("o_orderdate").cast("timestamp")


QUERIES = {
    "text_token_and": lambda s, d: (x := documents(s, d)).query().filter(x.model.text == "the of").df.select("doc_id"),
    "text_token_not": lambda s, d: (x := documents(s, d)).query().filter(x.model.text != "the of").df.select("doc_id"),
    "text_overlap_score": _overlap,
    "text_min_score": _min_score,
    "text_bm25_topk": lambda s, d: tx.bm25(table(s, d, "documents"), "doc_id", F.col("text"), ["the", "with", "was"]).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20),
    "text_bm25_query": lambda s, d: (x := documents(s, d)).query().filter(x.model.text == "the with").scored("bm25").df.select("doc_id", F.round("_score", 4).alias("score")),
    "text_highlight_count": lambda s, d: (x := documents(s, d)).query().filter(x.model.text == "und").highlighted(x.model.text, "und").select("doc_id", F.size(F.split("highlight", "<em>")).cast("long").alias("pieces")),
    "text_token_counts": lambda s, d: table(s, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n >= 200"),
    "knn_cosine": _knn("cosine"),
    "knn_euclidean": _knn("euclidean"),
    "knn_dot": _knn("dot"),
    "knn_hybrid_filter": _knn("cosine", 10, lambda m: m.label == 3),
    "vector_norms": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm")),
    "geo_distance_sort": _geo_sorted,
    "geo_within_radius": lambda s, d: (c := customers_with_places(s, d)).query().filter(c.model.point.within(HOME, 3_000_000.0)).df.select("c_custkey"),
    "geo_point_in_polygon": lambda s, d: (c := customers_with_places(s, d)).query().filter(c.model.point.spatial_intersects(SQUARE)).df.select("c_custkey"),
    "geo_polygon_arrays": lambda s, d: (c := customers_with_places(s, d)).query().filter(c.model.geos.spatial_intersects(SQUARE)).df.select("c_custkey"),
    "json_extract_filter": lambda s, d: table(s, d, "events").where(v.json_field(F.col("props"), "k", "int") > 50).select("event_id", v.json_field(F.col("props"), "k", "int").alias("k")),
    "ts_fields": lambda s, d: table(s, d, "orders").select("o_orderkey", *[ts.field(F.col("o_orderdate"), f).alias(f) for f in ("year", "month", "day", "hour", "minute", "second")]),
    "ts_days_between": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(ts.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days")).groupBy("days").agg(F.count("*").alias("n")),
    "ts_midnight": lambda s, d: table(s, d, "events").select("event_id", ts.midnight(F.col("ts")).cast("date").alias("day")),
    "ts_plus": lambda s, d: table(s, d, "orders").select("o_orderkey", ts.plus(_time(), 3, "month").cast("date").alias("later"), ts.minus(_time(), 10, "day").cast("date").alias("sooner")),
    "ts_parse": lambda s, d: table(s, d, "orders").select("o_orderkey", ts.parse(F.date_format("o_orderdate", "d MMM yyyy")).cast("date").alias("from_text"), ts.parse(ts.millis(F.col("o_orderdate")).cast("string")).cast("date").alias("from_millis"), ts.parse(F.date_format("o_orderdate", "dd/MM/yyyy"), day_first=True).cast("date").alias("from_day_first")),
    "distance_units": lambda s, d: table(s, d, "customer").select("c_custkey", F.round(ds.convert(F.col("c_custkey").cast("double"), "miles", "kilometers"), 6).alias("km"), F.round(ds.convert(F.col("c_custkey").cast("double"), "micrometers", "millimeters"), 6).alias("mm")),
    "value_decode": lambda s, d: table(s, d, "part").select("p_partkey", F.size(v.decode(F.regexp_replace("p_name", " ", ";;"), "array<string>")).cast("long").alias("words"), v.keyword(F.concat(F.lit(" "), F.col("p_brand"))).alias("brand"), v.incrementing_id(F.col("p_partkey")).alias("id")),
    "graph_edges_for": lambda s, d: (e := edges(s, d)).join(_seeds(s, d)[1], F.col("_from") == F.col("node"), "left_semi"),
    "graph_bfs_depth": lambda s, d: graph.bfs(*_seeds(s, d), 3),
    "graph_traverse_edges": lambda s, d: graph.traverse(*_seeds(s, d), 2).select("_from", "_to", "depth"),
    "graph_reachable": lambda s, d: graph.target_ids(*_seeds(s, d), 12),
    "graph_follow_hetero": _follow,
    "graph_shortest_paths": _shortest,
    "graph_all_paths": _all_paths,
    "graph_lookup": _graph_lookup,
    "graph_hop": _hop,
    "graph_components": _components,
    "graph_reverse": lambda s, d: graph.reverse(edges(s, d)).groupBy("_from").agg(F.count("*").alias("n")),
    "stream_windows": lambda s, d: changes.windowed(table(s, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"], n=F.count("*")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n"),
    "change_log_latest": lambda s, d: changes.latest(table(s, d, "events").select(F.col("user_id"), F.col("event_id"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("upsert").alias("_op"), F.col("event_id").alias("_seq")), "user_id"),
}

_TOKENS = "t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)"
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_HAVERSINE = "2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2))))"
_PLACES = "p AS (SELECT c_custkey, (c_custkey * 37 % 160 - 80)::DOUBLE AS lat, (c_custkey * 91 % 340 - 170)::DOUBLE AS lon FROM customer)"
_SEEDS = "seeds AS (SELECT s AS node FROM e GROUP BY s ORDER BY count(*) DESC, s LIMIT {})"


def _reach(depth: int, n: int = 5) -> str:
    return f"WITH RECURSIVE {EDGES}, {_SEEDS.format(n)}, r AS (SELECT node, 0 AS depth FROM seeds UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.s = r.node WHERE r.depth < {depth}), b AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"


def _paths(depth: int, shortest: bool) -> str:
    keep = "WHERE length = (SELECT min(length) FROM f)" if shortest else ""
    return f"""WITH RECURSIVE {EDGES}, a AS (SELECT s AS node FROM e GROUP BY s ORDER BY count(*) DESC, s LIMIT 1),
        r AS (SELECT node, 0 AS depth FROM a UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.s = r.node WHERE r.depth < 3),
        z AS (SELECT min(node) AS node FROM (SELECT node FROM r GROUP BY node HAVING min(depth) = 2)),
        p AS (SELECT [node] AS path FROM a UNION ALL SELECT list_append(path, e.t) FROM p JOIN e ON e.s = path[-1] WHERE len(path) <= {depth} AND NOT list_contains(path, e.t) AND path[-1] <> (SELECT node FROM z)),
        f AS (SELECT path, len(path) - 1 AS length FROM p WHERE path[-1] = (SELECT node FROM z))
        SELECT array_to_string(path, '>') AS path, length::INT AS length FROM f {keep}"""


def _bm25(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(words))
    seen = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    total = " + ".join(f"ln(1 + (rows - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_n))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"WITH {_TOKENS}, c AS (SELECT doc_id, w, len(w) AS n, {tf} FROM t), g AS (SELECT count(*) AS rows, avg(n) AS avg_n, {seen} FROM c), s AS (SELECT doc_id, w, {total} AS score FROM c, g WHERE {some})"


ORACLES = {
    "text_token_and": f"WITH {_TOKENS} SELECT doc_id FROM t WHERE list_has_all(w, ['the', 'of'])",
    "text_token_not": f"WITH {_TOKENS} SELECT doc_id FROM t WHERE NOT list_has_all(w, ['the', 'of'])",
    "text_overlap_score": f"WITH {_TOKENS}, m AS (SELECT doc_id, list_has_all(w, ['the', 'of']) AS a, list_contains(w, 'with') AS b FROM t) SELECT doc_id, a::INT * 2.0::DOUBLE + b::INT * 2.0::DOUBLE AS score FROM m WHERE a OR b ORDER BY 2 DESC, 1 LIMIT 30",
    "text_min_score": f"WITH {_TOKENS}, m AS (SELECT doc_id, list_contains(w, 'the')::INT + 3.0::DOUBLE * list_contains(w, 'und')::INT + list_contains(w, 'of')::INT AS score FROM t) SELECT doc_id, score FROM m WHERE score >= 2",
    "text_bm25_topk": _bm25(["the", "with", "was"]) + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 20",
    "text_bm25_query": _bm25(["the", "with"]) + " SELECT doc_id, round(score, 4) AS score FROM s WHERE list_has_all(w, ['the', 'with'])",
    "text_highlight_count": f"WITH {_TOKENS} SELECT doc_id, 1 + len(list_filter(w, lambda x: x = 'und'))::BIGINT AS pieces FROM t WHERE list_contains(w, 'und')",
    "text_token_counts": f"WITH {_TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM t) GROUP BY 1 HAVING count(*) >= 200",
    "knn_cosine": f"SELECT vec_id FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_VEC}), vec_id LIMIT 10",
    "knn_euclidean": f"SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_VEC}), vec_id LIMIT 10",
    "knn_dot": f"SELECT vec_id FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {_VEC}), vec_id LIMIT 10",
    "knn_hybrid_filter": f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], {_VEC}), vec_id LIMIT 10",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "geo_distance_sort": f"WITH {_PLACES}, d AS (SELECT c_custkey, {_HAVERSINE} AS m FROM p) SELECT c_custkey, round(m, 0) AS meters FROM d WHERE m <= 5000000 ORDER BY m, c_custkey LIMIT 25",
    "geo_within_radius": f"WITH {_PLACES} SELECT c_custkey FROM p WHERE {_HAVERSINE} <= 3000000",
    "geo_point_in_polygon": f"WITH {_PLACES} SELECT c_custkey FROM p WHERE lat >= -20 AND lat < 50 AND lon >= -60 AND lon < 70",
    "geo_polygon_arrays": f"WITH {_PLACES} SELECT c_custkey FROM p WHERE lat BETWEEN -20 AND 50 AND lon BETWEEN -60 AND 70",
    "json_extract_filter": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k')::INT > 50",
    "ts_fields": "SELECT o_orderkey, " + ", ".join(f"extract({f} FROM o_orderdate)::INT AS {f}" for f in ("year", "month", "day", "hour", "minute", "second")) + " FROM orders",
    "ts_days_between": "SELECT floor(abs(epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) / 86400000)::BIGINT AS days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "ts_midnight": "SELECT event_id, ts::DATE AS day FROM events",
    "ts_plus": "SELECT o_orderkey, (o_orderdate + INTERVAL 3 MONTH)::DATE AS later, (o_orderdate - INTERVAL 10 DAY)::DATE AS sooner FROM orders",
    "ts_parse": "SELECT o_orderkey, o_orderdate::DATE AS from_text, o_orderdate::DATE AS from_millis, o_orderdate::DATE AS from_day_first FROM orders",
    "distance_units": "SELECT c_custkey, round(c_custkey::DOUBLE * 1609.344 / 1000, 6) AS km, round(c_custkey::DOUBLE * 0.000001 / 0.001, 6) AS mm FROM customer",
    "value_decode": "SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS words, lower(trim(p_brand)) AS brand, lpad(p_partkey::VARCHAR, 19, '0') AS id FROM part",
    "graph_edges_for": f"WITH {EDGES}, {_SEEDS.format(5)} SELECT s AS _from, t AS _to FROM e WHERE s IN (SELECT node FROM seeds)",
    "graph_bfs_depth": _reach(3) + " SELECT node, depth::INT AS depth FROM b",
    "graph_traverse_edges": _reach(1) + " SELECT s AS _from, t AS _to, (depth + 1)::INT AS depth FROM e JOIN b ON e.s = b.node",
    "graph_reachable": _reach(12) + " SELECT node AS _id FROM b",
    "graph_follow_hetero": "SELECT DISTINCT o_custkey AS node FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_nationkey = 3",
    "graph_shortest_paths": _paths(3, True),
    "graph_all_paths": _paths(4, False),
    "graph_lookup": f"WITH RECURSIVE {EDGES}, {_SEEDS.format(10)}, r AS (SELECT node AS start, node, 0 AS depth FROM seeds UNION SELECT start, e.t, depth + 1 FROM r JOIN e ON e.s = r.node WHERE depth < 2) SELECT start AS node, count(DISTINCT node) FILTER (node <> start) AS n FROM r GROUP BY 1",
    "graph_hop": _reach(2, 10) + " SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT e.t FROM e JOIN b ON e.s = b.node WHERE b.depth < 2)",
    "graph_components": f"WITH RECURSIVE {EDGES}, u AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s AS node, s AS reach FROM u UNION SELECT r.node, u.t FROM r JOIN u ON u.s = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1) SELECT component, count(*) AS n FROM c GROUP BY 1",
    "graph_reverse": f"WITH {EDGES} SELECT t AS _from, count(*) AS n FROM e GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "change_log_latest": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 5 <> 0",
}
