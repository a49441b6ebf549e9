"""Every registered query of the archive operators against its DuckDB SQL on the smallest tables."""

import os

import pytest

from tidemark import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value as text that both engines write alike."""
    if isinstance(value, float):
        return f"{value:.9g}"
    return "~" if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the tables aren't here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql()) and len(queries.queries()) > 120


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
