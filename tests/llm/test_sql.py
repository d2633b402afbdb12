"""Queries that SQL can express, against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from driftline.llm.queries import ORACLE, QUERIES


def test_entry_module_offers_them():
    assert QUERIES.items() <= entry_module.queries().items() and ORACLE.items() <= entry_module.oracle_sql().items()
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] and {f"op{i}" for i in range(1, 14)} == {
        n.split("_")[0] for n in QUERIES if n != "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(session, data, name):
    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    rows = QUERIES[name](session, data)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, rows.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))
