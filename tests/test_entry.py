"""The driver's entry module."""

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_names():
    found, sql = e.queries(), e.oracle_sql()
    assert len(found) >= 150 and set(sql) <= set(found)
