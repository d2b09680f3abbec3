"""Every registered query against its SQL twin in DuckDB, on whole driver tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()
OWN = entry_points.QUERIES

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(OWN) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.sql(SQL[name])
    spark_types = {f.name: TYPES[f.dataType.simpleString()] for f in result.schema}
    assert spark_types == dict(zip(expected.columns, map(str, expected.types)))

    columns = sorted(result.columns)
    found = [tuple(row) for row in result.select(*[f"`{c}`" for c in columns]).collect()]
    wanted = expected.select(*[f'"{c}"' for c in columns]).fetchall()
    assert found and sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 5
