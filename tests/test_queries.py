"""Every registered query against its SQL, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    frame = entry_point.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted([tuple(cell(r[c]) for c in names) for r in frame.collect()], key=repr)
    cursor = database.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted([tuple(cell(r[i]) for i in order) for r in cursor.fetchall()], key=repr)
    assert got == want and got
