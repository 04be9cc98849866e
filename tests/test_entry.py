"""The registered queries against their SQL, on the smallest of the given data sets."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from wagelens.oracles import all_oracles
from wagelens.plans.derived import SOURCES
from wagelens.registry import all_queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for table in SOURCES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return db


def comparable(rows):
    return sorted((tuple(str(v) for v in row) for row in rows))


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, database, name):
    df = driver.queries()[name](spark, DATA)
    result = database.sql(driver.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    picked = [result.columns.index(c) for c in df.columns]
    theirs = [tuple(row[i] for i in picked) for row in result.fetchall()]
    assert comparable(df.collect()) == comparable(theirs)


def test_entry_answers_the_flagship_question(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_filings > 0


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
