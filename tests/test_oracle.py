"""Every registered query against its SQL: columns, types and rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from nearpath.queries import QUERIES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, duck, sf_dir, name):
    result = QUERIES[name].run(spark, sf_dir)
    columns = sorted(result.columns)
    expected = duck.execute(entry.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in expected.description}
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    order = [list(types).index(c) for c in columns]
    wanted = sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
    got = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    assert got == wanted
    assert got


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 500 * 10


def test_every_query_is_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
