"""Every registered text query that has SQL against it on the smallest tables."""

import os

import pytest

from tests.test_queries import FOLDER, TABLES, plain
from tidemark.llm import queries


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the tables aren't here")
    con = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found, want = queries.queries()[name](spark, FOLDER), duck.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
