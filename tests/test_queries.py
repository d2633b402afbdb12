"""Every registered query against its SQL on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from driftline.queries import ORACLE as SQL
from driftline.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return connection


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, data, name):
    columns, rows = spark_rows(QUERIES[name](spark, data))
    assert rows
    if name in SQL:
        expected_columns, expected = duck_rows(duck, SQL[name])
        assert columns == expected_columns
        assert rows == expected


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "seal_id"
