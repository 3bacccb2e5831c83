"""Every registered query against its SQL, whole tables of the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([plain(v) for v in row]) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = rows(entry.queries()[name](spark, FOLDER).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1], f"{name} returned nothing"
    else:
        assert got == rows(duck.execute(sql).df())


def test_the_entry_query_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
