"""Small fixtures with literal results, and random filters against a plain evaluation."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import filters as fl
from lodestar.collection import Collection, DuplicateIdError
from lodestar.model import Field, Model, NonIndexedFieldError, Sort

PEOPLE = [("adam", "Adam", 21, None, []), ("brenda", "Brenda", 11, "adam", []), ("charlie", "Charlie", 35, None, []), ("evan", "Evan", 53, None, []), ("jenna", "Jenna", 4, "hanna", []), ("oscar", "Oscar", 21, None, ["Grouchy"]), ("ruth", "Ruth", 102, None, []), ("tori", "Tori", 30, None, ["Nica"]), ("uba", "Uba", 21, None, ["multiple terms"]), ("veronica", "Veronica", 13, None, ["Vera", "Nica"]), ("wyatt", "Wyatt", 30, None, [])]


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(PEOPLE, "_id string, name string, age int, bestFriend string, nicknames array<string>")
    search = Field("search", derive=lambda: F.concat_ws(" ", "name", F.col("age").cast("string"))).as_tokenized()
    return Collection(Model.of("people", df, search=search), df)


def ids(q):
    return sorted(r["_id"] for r in q.df.select("_id").collect())


def test_strings(people):
    m, q = people.model, people.query()
    assert ids(q.filter(m.name.starts_with("Ver"))) == ["veronica"]
    assert ids(q.filter(m.name.ends_with("nica"))) == ["veronica"]
    assert ids(q.filter(m.name.regex(".*ron.*"))) == ["veronica"]
    assert ids(q.filter(m.name.regex("("))) == []
    assert ids(q.filter(m.name.contains("%"))) == []
    assert ids(q.filter(m.nicknames.has_any(["Grouchy", "Nica"]))) == ["oscar", "tori", "veronica"]
    assert ids(q.filter(m.nicknames.has_all(["Nica", "Vera"]))) == ["veronica"]
    assert ids(q.filter(m.nicknames.contains("ica"))) == ["tori", "veronica"]
    assert ids(q.filter(m.search == "veronica 13")) == ["veronica"]
    assert ids(q.filter(m.name.words("ver nica", match_starts=True, match_ends=True))) == []
    assert ids(q.filter(m.name.words("Ver nica", match_starts=True, match_ends=True))) == ["veronica"]


def test_nulls(people):
    m, q = people.model, people.query()
    assert ids(q.filter(m.bestFriend.is_in(["hanna", "ian"]))) == ["jenna"]
    assert len(ids(q.filter(m.bestFriend != "adam"))) == len(PEOPLE) - 1
    assert len(ids(q.filter(m.bestFriend.is_null()))) == len(PEOPLE) - 2
    assert len(ids(q.filter(~(m.bestFriend == "adam")))) == len(PEOPLE) - 1


def test_numbers_sort_and_pages(people):
    m, q = people.model, people.query()
    assert ids(q.filter(m.age.between(19, 22))) == ["adam", "oscar", "uba"]
    assert ids(q.filter(fl.Builder().must_not(m.age < 30).must_not(m.age > 35).build())) == ["charlie", "tori", "wyatt"]
    assert [r["name"] for r in q.sort(m.age.desc()).limit(2).df.collect()] == ["Ruth", "Evan"]
    page = q.sort(m.age.asc()).offset(2).page_size(3).count_total().search()
    assert [r["_id"] for r in page.list()] == ["veronica", "adam", "oscar"] and page.total == len(PEOPLE) and page.remaining == len(PEOPLE) - 5
    assert q.count() == len(PEOPLE) and q.first()["_id"] == "adam"


def test_scores(people):
    m = people.model
    f = fl.Builder().min_should(0).should(m.age == 21, 2.0).should(m.name.starts_with("U"), 3.0).build()
    got = people.query().filter(f).scored().sort(Sort.best_match()).limit(3).df.select("_id", "_score").collect()
    assert [(r["_id"], r["_score"]) for r in got] == [("uba", 5.0), ("adam", 2.0), ("oscar", 2.0)]
    assert ids(people.query().filter(f).scored().min_score(3.0)) == ["uba"]


def test_strict(spark):
    df = spark.createDataFrame([("a", 1)], "_id string, n int")
    c = Collection(Model("strict", Field("n"), strict=True), df)
    with pytest.raises(NonIndexedFieldError):
        c.query().filter(c.model.n == 1).count()


def test_nested(spark):
    rows = [("d1", [("a", 0.2), ("b", 0.9)]), ("d2", [("a", 0.8)]), ("d3", [("c", 0.7)]), ("d4", [("a", 0.6), ("z", 0.1)]), ("d5", None)]
    df = spark.createDataFrame(rows, "_id string, attrs array<struct<key:string,percent:double>>")
    c = Collection(Model.of("nested", df), df)
    m = c.model
    assert ids(c.query().filter(m.attrs.nested(lambda a: (a.key == "a") & (a.percent >= 0.5)))) == ["d2", "d4"]
    assert ids(c.query().filter(m.attrs.nested(lambda a: fl.Builder().must(a.key == "a").must(a.percent >= 0.5).must_not(a.key == "z").build()))) == ["d2"]


def test_nested_in_nested(spark):
    rows = [("d1", [("A", [("x", 0.2)]), ("B", [("y", 0.9)])]), ("d2", [("A", [("x", 0.8)])]), ("d3", [("C", [("y", 0.7)])]), ("d4", [("A", [("x", 0.6), ("z", 0.1)])])]
    df = spark.createDataFrame(rows, "_id string, outers array<struct<name:string,children:array<struct<code:string,score:double>>>>")
    c = Collection(Model.of("nested2", df), df)
    m = c.model
    x = lambda e: (e.code == "x") & (e.score >= 0.5)
    assert ids(c.query().filter(m.outers.nested(lambda o: o.children.nested(x)))) == ["d2", "d4"]
    assert ids(c.query().filter(m.outers.nested(lambda o: o.children.nested(lambda e: fl.Builder().must(x(e)).must_not(e.code == "z").build())))) == ["d2"]


def test_children(spark):
    parents = spark.createDataFrame([(x[0], x) for x in ("Alpha", "Bravo", "Charlie", "Delta", "Echo")], "_id string, name string")
    kids = [("A", "WY", None), ("A", None, "68W"), ("B", "WY", "69W"), ("C", None, "68W"), ("D", "UT", None), ("D", None, "70W"), ("E", "UT", "70W")]
    children = spark.createDataFrame([(f"c{i}", *k) for i, k in enumerate(kids)], "_id string, parentId string, state string, range string")
    p, c = Collection(Model.of("parents", parents), parents), Collection(Model.of("children", children), children)
    s, r = c.model.state, c.model.range

    def names(f):
        return sorted(x["name"] for x in p.query().filter(f).df.collect())

    r = c.model.field("range")
    assert names(p.exists_child(c, "parentId", s == "WY")) == ["Alpha", "Bravo"]
    assert names(fl.collective(c, "parentId", [s == "WY", r == "68W"])) == ["Alpha"]
    assert names(fl.same_child(c, "parentId", [s == "UT", r == "70W"])) == ["Echo"]
    assert len(names(fl.collective(c, "parentId", []))) == 5
    assert names(~p.exists_child(c, "parentId", s == "WY")) == ["Charlie", "Delta", "Echo"]


def test_transactions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, n int")
    c = Collection(Model.of("t", df), df)
    with c.transaction() as t:
        t.insert([("c", 3)])
    with pytest.raises(DuplicateIdError), c.transaction() as t:
        t.insert([("a", 9)])
    assert c.count() == 3
    with c.transaction() as t:
        t.upsert([("a", 9), ("a", 10), ("d", 4)])
        t.delete("b")
    assert {r["_id"]: r["n"] for r in c.df.collect()} == {"a": 10, "c": 3, "d": 4}
    with c.transaction() as t:
        t.modify("a", lambda r: {**r, "n": r["n"] + 1})
        t.get_or_create("z", lambda: {"_id": "z", "n": 0})
    assert c["a"]["n"] == 11 and c["z"]["n"] == 0 and c.get("b") is None


def test_sales_having(spark):
    df = spark.createDataFrame([("1", "A", 10), ("2", "A", 5), ("3", "B", 3), ("4", "B", 7), ("5", "C", 1)], "_id string, category string, amount int")
    c = Collection(Model.of("sales", df), df)
    g, total, n = c.model.category.group(), c.model.amount.sum(), c.model.amount.count()
    rows = c.query().aggregate(g, total, n).filter(g != "C").sort(total.desc()).list()
    assert [(r["categoryGroup"], r["amountSum"], r["amountCount"]) for r in rows] == [("A", 15, 2), ("B", 10, 2)]
    assert c.query().aggregate(total).filter(total > 100).list() == []


# random filters, against their meaning written once more in plain Python

SCHEMA = T.StructType([T.StructField("_id", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def leaf(rng):
    kind = rng.randrange(6)
    if kind == 0:
        v = rng.choice([0, 1, 2, None])
        return fl.Equals("a", v), lambda r: r["a"] == v
    if kind == 1:
        v = rng.choice([0, 1, 2])
        return fl.NotEquals("a", v), lambda r: r["a"] != v
    if kind == 2:
        lo, strict = rng.randrange(3), rng.random() < 0.5
        return fl.Range("a", lo, None, not strict), lambda r: r["a"] is not None and (r["a"] > lo if strict else r["a"] >= lo)
    if kind == 3:
        p = rng.choice(["x", "y", "%", "_"])
        return fl.Text("s", "contains", p), lambda r: r["s"] is not None and p in r["s"]
    if kind == 4:
        vs = rng.sample(["p", "q", "r"], 2)
        return fl.In("tags", tuple(vs)), lambda r: bool(set(vs) & set(r["tags"] or []))
    vs = rng.sample(["p", "q", "r"], 2)
    return fl.Equals("tags", vs), lambda r: r["tags"] is not None and set(vs) <= set(r["tags"])


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return leaf(rng)
    parts = [(tree(rng, depth - 1), rng.choice(["must", "must_not", "filter", "should"])) for _ in range(rng.randrange(1, 4))]
    n = rng.randrange(0, 3)

    def test(r):
        should = [f(r) for (_, f), c in parts if c == "should"]
        return all(f(r) for (_, f), c in parts if c in ("must", "filter")) and not any(f(r) for (_, f), c in parts if c == "must_not") and (not should or sum(should) >= n)

    return fl.Multi(tuple(fl.Clause(f, c) for (f, _), c in parts), n), test


def test_random_filters(spark):
    rng = random.Random(5)
    rows = [(str(i), rng.choice([0, 1, 2, 3, None]), rng.choice(["x", "xy", "y%", "_", "", None]), rng.choice([None, [], ["p"], ["p", "q"], ["q", "r", "p"]])) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    c = Collection(Model.of("random", df), df)
    dicts = [dict(zip(("_id", "a", "s", "tags"), r, strict=True)) for r in rows]
    filters = [tree(rng, 3) for _ in range(25)]
    scope = c.query().scope
    flags = df.select("_id", *[F.coalesce(f.column(scope), F.lit(False)).alias(f"f{i}") for i, (f, _) in enumerate(filters)]).collect()
    for row in flags:
        r = dicts[int(row["_id"])]
        assert [row[f"f{i}"] for i in range(len(filters))] == [t(r) for _, t in filters]
