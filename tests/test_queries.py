"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = driver.SMOKE_FOLDER
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        name, kind = os.path.splitext(file)
        if kind == ".parquet":
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def rows_of(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, values.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    want = tables.sql(driver.oracle_sql()[name]).df()
    # integers with nulls: only one of the two keeps them integers in pandas
    got = got.astype({c: "Int64" for c in want.columns if str(want[c].dtype) == "Int64"})
    assert list(got.dtypes.sort_index()) == list(want.dtypes.sort_index())
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 25
