"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from nearpath.llm.queries import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    result = QUERIES[name](spark, sf_dir)
    expected = duck.execute(SQL[name])
    types = {column[0]: str(column[1]) for column in expected.description}
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    wanted = sorted(repr(row) for row in expected.fetchall())
    got = sorted(repr(tuple(row[c] for c in types)) for row in result.collect())
    assert got == wanted and got
