"""Caches, stored values, pushdown."""

import contextlib
import io

import pytest

from lodestar.collection import Collection, Database
from lodestar.model import Model
from lodestar.sources.caches import PointCache, ResultCache, StoredValue
from lodestar.tables import customers, orders
from conftest import SMALL


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_caches(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, n int")
    c = Collection(Model.of("cached", df), df)
    points, results = PointCache(c, size=1), ResultCache(c)
    assert points.get("a")["n"] == points.get("a")["n"] == 1 and (points.hits, points.misses) == (1, 1)
    first = results.get("all", lambda: c.query().df)
    assert results.get("all", lambda: None) is first
    with c.transaction() as t:
        t.upsert([("a", 5)])
    assert points.get("a")["n"] == 5 and points.get("z") is None
    assert {r["n"] for r in results.get("all", lambda: c.query().df).collect()} == {5, 2}


def test_stored_value(spark):
    kv = Database(spark).collection(Model("values", key="_id"), spark.createDataFrame([], "_id string, json string"))
    v = StoredValue(kv, "n", lambda: 0)
    assert v.get() == 0 and v.modify(lambda n: n + 1) == 1 and v.get() == 1
    v.clear()
    assert v.get() == 0


def test_upgrades(spark):
    db, done = Database(spark), []
    db.upgrades = [("one", lambda d: done.append(1)), ("two", lambda d: done.append(2))]
    assert db.upgrade() == ["one", "two"] and db.upgrade() == [] and done == [1, 2]


@pytest.mark.parametrize(("build", "pushed"), [
    (lambda m: m.c_acctbal.between(1.0, 2.0), "GreaterThanOrEqual(c_acctbal,1.0)"),
    (lambda m: m.c_mktsegment == "BUILDING", "EqualTo(c_mktsegment,BUILDING)"),
    (lambda m: m.c_name.starts_with("C"), "StringStartsWith(c_name,C)"),
    (lambda m: m.c_nationkey.is_in([1, 2]), "In(c_nationkey, [1,2])"),
    (lambda m: (m.c_nationkey == 1) | (m.c_acctbal > 5.0), "Or("),
])
def test_filters_reach_the_scan(spark, build, pushed):
    c = customers(spark, SMALL)
    text = plan(c.query().filter(build(c.model)).df.select("c_custkey"))
    assert pushed in text or pushed.replace("EqualTo", "EqualNullSafe") in text
    assert "Python" not in text


def test_child_filter_is_a_semi_join(spark):
    c, o = customers(spark, SMALL), orders(spark, SMALL)
    text = plan(c.query().filter(c.exists_child(o, "o_custkey", o.model.o_totalprice > 1.0)).df)
    assert "LeftSemi" in text and "GreaterThan(o_totalprice,1.0)" in text


def test_top_k_is_one_operator(spark):
    o = orders(spark, SMALL)
    assert "TakeOrderedAndProject" in plan(o.query().sort(o.model.o_totalprice.desc()).limit(5).df)


def test_service(spark):
    import json
    import threading
    import urllib.error
    import urllib.request

    from lodestar.sources import service

    db = Database(spark)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, n int")
    db.collection(Model.of("things", df), df)
    server = service.serve(db)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(**request):
        url = f"http://127.0.0.1:{server.server_port}"
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(request).encode()), timeout=60) as r:
            return [json.loads(x) for x in r.read().splitlines()]

    try:
        assert ask(op="ListStores") == [["things"]] and ask(op="Count", store="things") == [2]
        assert ask(op="Get", store="things", id="a") == [{"_id": "a", "n": 1}]
        assert ask(op="Upsert", store="things", docs=[{"_id": "c", "n": 3}]) == [1]
        ask(op="Delete", store="things", ids=["a"])
        assert ask(op="ListDocs", store="things", offset=0, limit=5) == [[{"_id": "b", "n": 2}, {"_id": "c", "n": 3}]]
        assert sorted(r["_id"] for r in ask(op="Stream", store="things")) == ["b", "c"]
        ask(op="Truncate", store="things")
        assert ask(op="Count", store="things") == [0]
        with pytest.raises(urllib.error.HTTPError):
            ask(op="Fly", store="things")
    finally:
        server.shutdown()


def test_multipolygon_holes():
    import json

    from lodestar.functions import geo as g

    square = lambda a, b: [[a, a], [a, b], [b, b], [b, a], [a, a]]
    text = json.dumps({"type": "MultiPolygon", "coordinates": [[square(0, 10), square(4, 6)], [square(20, 30)]]})
    for many in (g.from_geojson(text), g.from_wkt("MULTIPOLYGON (((0 0, 0 10, 10 10, 10 0, 0 0), (4 4, 4 6, 6 6, 6 4, 4 4)), ((20 20, 20 30, 30 30, 30 20, 20 20)))")):
        inside = [g._covers_point(many, p) for p in ((5, 5), (2, 2), (25, 25), (15, 15), (4, 5))]
        assert inside == [False, True, True, False, True]
        assert json.loads(g.to_geojson(many)) == json.loads(text.replace("10", "10.0").replace(" 0", " 0.0")) or [len(p) for p in json.loads(g.to_geojson(many))["coordinates"]] == [2, 1]
    features = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "geometry": None}]}
    assert [x.kind for x in g.from_geojson(features)] == ["Point"]


def test_long_shortest_path_and_null_keys(spark):
    from lodestar.collection import Collection
    from lodestar.model import Model
    from lodestar.operators import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "_from long, _to long")
    assert [r["length"] for r in graph.shortest_paths(chain, 0, 70).collect()] == [70]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    tx = Collection(Model.of("t", df, key="k"), df).transaction()
    tx.delete(1)
    assert sorted(r["v"] for r in tx.current.collect()) == ["b", "c"]


def test_scopes_of_odd_names(spark, tmp_path):
    from lodestar.plans.views import View

    rows = [("a/b", 1), (None, 2), ("c", 3)]
    now = {"df": spark.createDataFrame(rows, "s string, n long")}
    view = View("odd", type("Rows", (), {"df": lambda self: now["df"]})(), spark, folder=f"file://{tmp_path}", scope="s")
    view.rebuild()
    now["df"] = spark.createDataFrame(rows[2:], "s string, n long")
    view.refresh(["a/b", None])
    assert [tuple(r) for r in view._read().select("s", "n").collect()] == [("c", 3)]
