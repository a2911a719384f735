"""Facets, graphs, pipelines, geometry, time, views, files: small fixtures with literal results."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.collection import Collection, Database
from lodestar.functions import distances, geo, timestamps, vectors
from lodestar.functions import text as tx
from lodestar.model import Field, Model
from lodestar.operators import facets, graph, grouping
from lodestar.operators.pipeline import Accumulator, Pipeline
from lodestar.plans import sqlapi as q
from lodestar.plans.relation import Scan
from lodestar.plans.views import Materialization, View
from lodestar.sources import files
from lodestar.streaming import changes


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("One", ["Bob", "James"], [2010, 10, 15]), ("Two", ["Lisa"], [2010, 10, 20]), ("Three", ["Lisa"], [2012, 1, 1]), ("Four", ["Susan"], [2012, 1, 7]), ("Five", ["Frank"], [1999, 5, 5]), ("Six", ["George"], [1999]), ("Seven", ["Bob"], [])]
    df = spark.createDataFrame([(n, a, [[str(x) for x in d]]) for n, a, d in rows], "_id string, authors array<string>, date array<array<string>>")
    return Collection(Model.of("entries", df), df)


def test_facets(entries):
    r = entries.query().facet("authors").facet("date").search().facets
    assert [(x["label"], x["n"]) for x in r["authors"].values] == [("Bob", 2), ("Lisa", 2), ("Frank", 1), ("George", 1), ("James", 1), ("Susan", 1)]
    assert (r["authors"].child_count, r["authors"].total_count) == (6, 8)
    assert [(x["label"], x["n"]) for x in r["date"].values] == [("1999", 2), ("2010", 2), ("2012", 2)]
    assert (r["date"].child_count, r["date"].total_count) == (4, 6)
    below = facets.compute(entries.df, facets.FacetRequest("date", ("2010", "10")))
    assert [(x["label"], x["n"]) for x in below.values] == [("15", 1), ("20", 1)]
    d = entries.model.field("date")
    assert sorted(x["_id"] for x in entries.query().filter(d.drill_down("1999")).df.collect()) == ["Five", "Six"]
    assert [x["_id"] for x in entries.query().filter(d.drill_down("1999", only_this_level=True)).df.collect()] == ["Six"]


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A")], "_from string, _to string")


def test_graph(spark, diamond):
    assert {(r["node"], r["depth"]) for r in graph.bfs(diamond, ["A"]).collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2)}
    assert {r["node"] for r in graph.bfs(diamond, ["A"], 1).collect()} == {"A", "B", "C"}
    assert sorted(r["path"] for r in graph.shortest_paths(diamond, "A", "D").collect()) == [["A", "B", "D"], ["A", "C", "D"]]
    assert sorted(r["path"] for r in graph.all_paths(diamond, "A", "D", 5).collect()) == [["A", "B", "D"], ["A", "C", "D"]]
    assert graph.shortest_paths(diamond, "A", "X").count() == 0
    assert graph.traverse(diamond, ["A"], 1).count() == 2
    assert graph.reachable(diamond, "B").count() == 5
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "_from string, _to string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert {(r["node"], r["component"]) for r in graph.components(e, nodes).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "_from long, _to long")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}
    assert [r["_from"] for r in graph.reverse(e).where("_to = 'a'").collect()] == ["b"]
    assert sorted(r[0] for r in graph.collect_reachable(spark.createDataFrame([("a",)], "node string"), lambda f: f.join(e, F.col("node") == F.col("_from")).select("_to")).collect()) == ["a", "b", "c"]


def test_pipeline(spark):
    df = spark.createDataFrame([(x,) for x in "baacbadb"], "k string")
    assert [(r["key"], r["count"]) for r in Pipeline(df).facet_top("k", 3).df.collect()] == [("a", 3), ("b", 3), ("c", 1)]
    n = spark.createDataFrame([(x,) for x in (9, 1, 5, 3, 2, 8, 4, 7, 6)], "n int")
    assert [r["n"] for r in Pipeline(n).sort_page("n", offset=2, limit=3).df.collect()] == [3, 4, 5]
    a = Accumulator(F.col("n").cast("long"), F.lit(1).cast("long"), lambda s, x: s * x)
    assert Pipeline(n).reduce(product=a).df.first()["product"] == 362880
    people = spark.createDataFrame([("p1", "x"), ("p2", None)], "_id string, best string")
    pets = spark.createDataFrame([("x", "p1"), ("y", "p1")], "_id string, owner string")
    out = Pipeline(people).lookup(pets, "best", name="pet").lookup_many(pets, "_id", "owner", "pets").df.orderBy("_id").collect()
    assert out[0]["pet"]["_id"] == "x" and [p["_id"] for p in out[0]["pets"]] == ["x", "y"] and out[1]["pet"] is None and out[1]["pets"] == []
    edges = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1")], "_from string, _to string")
    got = {r["_id"]: r["reached"] for r in Pipeline(people).graph_lookup(edges, "_id", 3).df.collect()}
    assert got == {"p1": ["p2", "p3"], "p2": ["p1", "p3"]}


def test_grouping(spark):
    df = spark.createDataFrame([(f"{i:02d}", "abc"[i % 3], i) for i in range(10)], "_id string, g string, n int")
    out = grouping.top_docs(df, "g", "_id", docs_per_group=2, within=[F.desc("n")], group_sort=F.desc("n"), group_limit=2).orderBy("group_rank", "doc_rank").collect()
    assert [(r["g"], r["n"]) for r in out] == [("a", 9), ("a", 6), ("c", 8), ("c", 5)]


def test_geometry(spark):
    city, noble = geo.Geo.point(35.5514, -97.4075), geo.Geo.point(35.1417, -97.409)
    df = spark.createDataFrame([(1, (35.1417, -97.409)), (2, (40.7142, -74.0119))], "_id int, point struct<lat:double,lon:double>")
    c = Collection(Model.of("places", df), df)
    rows = c.query().distance(c.model.point, city, radius=distances.Distance.of(1400, "miles").meters).collect()
    assert [r["_id"] for r in rows] == [1, 2] and abs(rows[0]["distance"][0] / 1609.344 - 28) < 1 and abs(rows[1]["distance"][0] / 1609.344 - 1316) < 30
    square = geo.from_wkt("POLYGON((-98 35, -97 35, -97 36, -98 36, -98 35))")
    assert geo.contains(square, noble) and not geo.intersects(square, geo.Geo.point(40, -74)) and geo.relation(noble, square) == "within"
    hole = geo.Geo.polygon([(0, 0), (0, 10), (10, 10), (10, 0)], [(4, 4), (4, 6), (6, 6), (6, 4)])
    assert not geo.contains(hole, geo.Geo.point(5, 5)) and geo.contains(hole, geo.Geo.point(1, 1))
    assert [r["_id"] for r in c.query().filter(c.model.point.spatial_intersects(square)).df.collect()] == [1]
    g = geo.from_geojson('{"type": "Polygon", "coordinates": [[[-98, 35], [-97, 35], [-97, 36], [-98, 35]]]}')
    assert geo.from_geojson(geo.to_geojson(g)) == g
    many = spark.createDataFrame([(1, [square.row()]), (2, [geo.Geo.point(0, 0).row()]), (3, None)], f"_id int, geos array<{geo.GEO}>")
    c = Collection(Model.of("geos", many), many)
    assert [r["_id"] for r in c.query().filter(c.model.geos.spatial_contains(noble)).df.collect()] == [1]
    with pytest.raises(ValueError):
        inner = spark.createDataFrame([(1, [((1.0, 2.0),)])], "_id int, xs array<struct<p:struct<lat:double,lon:double>>>")
        c = Collection(Model.of("inner", inner), inner)
        c.query().filter(c.model.xs.nested(lambda x: x.p.within(city, 1.0))).df.collect()


def test_units():
    assert distances.Distance.of(1, "miles").to("feet") == pytest.approx(5280)
    assert distances.Distance.of(1, "micrometers").meters == 1e-6


def test_time(spark):
    texts = ["2024-03-05", "2024-03-05T10:20:30.123Z", "1709634030", "1709634030123", "Tue, 05 Mar 2024 10:20:30 GMT", "03/05/2024", "Mar 5, 2024", "never", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["d"] for r in df.select("i", timestamps.parse(F.col("t")).cast("string").alias("d")).orderBy("i").collect()]
    assert got == ["2024-03-05 00:00:00", "2024-03-05 10:20:30.123", "2024-03-05 10:20:30", "2024-03-05 10:20:30.123", "2024-03-05 10:20:30", "2024-03-05 00:00:00", "2024-03-05 00:00:00", None, None]
    assert df.select(timestamps.parse(F.lit("05/03/2024"), day_first=True).cast("date").cast("string")).first()[0] == "2024-03-05"
    assert spark.range(1).select(timestamps.month_of(F.lit("Sept")).isNull(), timestamps.month_of(F.lit("sep"))).first()[1] == 9


def test_vectors_and_text(spark):
    rows = [("apple", "fruit", [1.0, 0.0, 0.0]), ("almost", "fruit", [0.9, 0.1, 0.0]), ("banana", "fruit", [0.0, 1.0, 0.0]), ("car", "vehicle", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "_id string, category string, embedding array<double>")
    c = Collection(Model.of("vectors", df, embedding=Field("embedding").as_vector(3)), df)
    assert [r["_id"] for r in c.query().sort(c.model.embedding.knn([1, 0, 0])).limit(2).df.collect()] == ["apple", "almost"]
    assert [r["_id"] for r in c.query().filter(c.model.category == "vehicle").sort(c.model.embedding.knn([1, 0, 0])).limit(2).df.collect()] == ["car"]
    assert df.select(vectors.euclidean(F.col("embedding"), vectors.vector([1, 0, 0]))).first()[0] == 0.0
    docs = spark.createDataFrame([("1", "the quick Fox"), ("2", "fox fox fox"), ("3", "dog")], "_id string, t string")
    best = tx.bm25(docs, "_id", F.col("t"), ["fox"]).orderBy(F.desc("score")).collect()
    assert [r["_id"] for r in best] == ["2", "1"]
    assert docs.select(tx.highlight(F.col("t"), ["fox"])).first()[0] == "the quick <em>Fox</em>"


def test_views(spark, tmp_path):
    rows = {"df": spark.createDataFrame([("adam", 21), ("brenda", 11)], "_id string, age int")}
    r = Scan("people", lambda: rows["df"], "p").where(F.col("p.age") >= 18).select(name=F.col("p._id"))
    db = Database(spark)
    c = db.collection(Model.of("people", rows["df"]), rows["df"])
    view = View("adults", r, spark, str(tmp_path), Materialization("triggered"))
    db.watch(view)
    assert [x["name"] for x in view.df.collect()] == ["adam"]
    with c.transaction() as t:
        t.upsert([("charlie", 35)])
    rows["df"] = c.stored
    assert sorted(x["name"] for x in view.df.collect()) == ["adam", "charlie"]


def test_sql(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string").createOrReplaceTempView("t_sql")
    got = q.select("n").from_("t_sql").where(q.col("n").gt(1) & (q.col("s").eq("b") | q.col("s").is_null())).order_by(q.col("n").desc()).run(spark)
    assert [r["n"] for r in got.collect()] == [3, 2]
    assert q.run(spark, "SELECT n FROM t_sql WHERE s = :s", s="a'; DROP").count() == 0
    assert q.fill("SELECT {c} FROM {t}", {"c": "n"}) == "SELECT n FROM {t}"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", None, [])], "_id string, n int, tags array<string>")
    db = Database(spark, str(tmp_path))
    c = db.collection(Model.of("things", df), df)
    before = sorted(map(str, c.stored.collect()))
    files.backup(db, str(tmp_path / "b"))
    files.zip_backup(str(tmp_path / "b"), str(tmp_path / "b.zip"))
    files.unzip_backup(str(tmp_path / "b.zip"), str(tmp_path / "again"))
    with c.transaction() as t:
        t.truncate()
    assert c.count() == 0
    files.restore(db, str(tmp_path / "again"))
    assert sorted(map(str, c.stored.collect())) == before
    (tmp_path / "x.tsv").write_text('a\tb\n1\t\\N\n2\t"q"\n')
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "x.tsv"), "a int, b string").collect()] == [(1, None), (2, '"q"')]
    (tmp_path / "blob").write_bytes(os.urandom(5000))
    chunks = files.blob_chunks(spark.read.format("binaryFile").load(str(tmp_path / "blob")), 1024)
    assert chunks.count() == 5
    assert b"".join(files.read_blob(chunks, chunks.first()["path"])) == (tmp_path / "blob").read_bytes()


def test_changes(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1, "upsert", 1)], "_id string, n int, _op string, _seq int").schema
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, "upsert", 1), ("b", 2, "upsert", 2), ("a", 5, "upsert", 3), ("b", 0, "delete", 4)], schema).write.parquet(log)
    seen = []
    stream = changes.follow(spark, log, schema, "_id", str(tmp_path / "t"), str(tmp_path / "cp"), lambda keys, path: seen.append((keys.count(), path)))
    stream.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(seen[-1][1]).collect()] == [("a", 5)] and seen[-1][0] == 2


def test_changes_restart_and_late_writes(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1, "upsert", 1)], "_id string, n int, _op string, _seq int").schema
    log, seen = str(tmp_path / "log"), []

    def write(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(log)
        changes.follow(spark, log, schema, "_id", str(tmp_path / "t"), str(tmp_path / "cp"), lambda keys, path: seen.append((sorted(r[0] or "" for r in keys.collect()), path))).awaitTermination(60)
        return seen[-1][0], sorted((r[0] or "", r[1]) for r in spark.read.parquet(seen[-1][1]).collect())

    first = write(("a", 1, "upsert", 1), ("b", 2, "upsert", 5), ("d", 4, "upsert", 6), (None, 9, "upsert", 1))
    assert first == (["", "a", "b", "d"], [("", 9), ("a", 1), ("b", 2), ("d", 4)])
    assert write(("c", 3, "upsert", 7), ("d", 0, "delete", 8)) == (["c", "d"], [("", 9), ("a", 1), ("b", 2), ("c", 3)])
    late = write(("b", 7, "upsert", 4), ("d", 7, "upsert", 7), ("a", 8, "upsert", 9), (None, 5, "upsert", 2))
    assert late == (["", "a"], [("", 5), ("a", 8), ("b", 2), ("c", 3)])


def test_parse_shapes(spark):
    shapes = {
        "05-Mar-2024": "2024-03-05 00:00:00",
        "05-Mar-2024 14:03": "2024-03-05 14:03:00",
        "5-mar-2024 2:03:09 PM": "2024-03-05 14:03:09",
        "2024-03-05 2:03:09 PM": "2024-03-05 14:03:09",
        "2024-03-05T2:03 am": "2024-03-05 02:03:00",
        "03/05/2024 14:03": "2024-03-05 14:03:00",
        "03/05/2024 2:03:09 PM": "2024-03-05 14:03:09",
        "20240305 14:03:09": "2024-03-05 14:03:09",
        "2024-03-05 14:03:09 Europe/Paris": "2024-03-05 13:03:09",
        "2024-03-05 14:03:09 +02:00": "2024-03-05 12:03:09",
        "Tue, 5 Mar 2024 14:03:09 -0500": "2024-03-05 19:03:09",
        "Tue, 5 Mar 2024 14:03:09 GMT": "2024-03-05 14:03:09",
        "2024-03-05T14:03:09+02:00": "2024-03-05 12:03:09",
        "2024-03-05 14:03:09 Nowhere/Land": None,
        "not a time": None,
    }
    df = spark.createDataFrame(list(shapes.items()), "t string, want string")
    got = {r["t"]: r["d"] for r in df.select("t", timestamps.parse(F.col("t")).cast("string").alias("d")).collect()}
    assert got == shapes


def test_parse_reads_a_text_once(spark):
    """A pattern is tried only where its shape fits, and no step on the text is in the plan once a pattern."""
    df = spark.createDataFrame([("5 Mar 2024",), ("+12024-03-05",), ("2024-03-05t10:20",), ("1/2/-2024",), ("Mar 5, 2024x",)], "t string").repartition(1)
    parsed = df.select("t", timestamps.parse(F.col("t")).alias("d"))
    text = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(") < 10
    for p in (*timestamps.PATTERNS, *timestamps.MONTH_FIRST, *timestamps.DAY_FIRST):
        assert df.where(F.try_to_timestamp("t", F.lit(p)).isNotNull() & ~F.col("t").rlike(timestamps.shape(p))).isEmpty()
    assert [r["t"] for r in parsed.where("d IS NOT NULL").select("t").collect()][:1] == ["5 Mar 2024"]
