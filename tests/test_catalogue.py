"""Every query of the catalogue against its SQL on the middle tables."""

import duckdb
import pytest
from conftest import MIDDLE

from lodestar import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10] if str(v).endswith("00:00:00") else str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MIDDLE}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, MIDDLE)
    cur = duck.execute(catalog.oracles()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((str(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in cur.fetchall()))
    got = sorted(str(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect())
    assert got == want
