"""Every registered query against its SQL twin on another engine."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from helpers import normal

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield con
    con.close()


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    found = driver.queries()[name](spark, FOLDER).toPandas()
    if name not in driver.oracle_sql():
        assert len(found) > 0
        return
    expected = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert normal(found) == normal(expected)


def test_entry(spark):
    report = driver.entry(spark)
    assert report.count() > 0
