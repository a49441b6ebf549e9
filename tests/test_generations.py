"""Names of generations beyond four digits: they widen, as the number in them does."""

import pytest
from pyspark.sql import functions as F

from tidemark import trip_queries  # noqa: F401  (registers its queries)
from tidemark.functions import paths as fp
from tidemark.queries import oracle_sql, queries

GENERATIONS = [1, 42, 9999, 10000, 10001, 123456]


@pytest.fixture
def check(rows, tmp_path):
    """The rows of a query over lineitem, which must be those of its SQL, as sorted tuples."""
    duckdb = pytest.importorskip("duckdb")

    def run(spark, name):
        where = f"{tmp_path}/lineitem.parquet"
        rows([(i, i % 7 + 1, 100 * i, g) for i, g in enumerate(GENERATIONS)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(where)
        found = queries()[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{where}/*.parquet'")
        want = con.sql(oracle_sql()[name])
        place = [want.columns.index(c) for c in found.columns]
        out = sorted(tuple(r) for r in found.collect())
        assert out == sorted(tuple(r[i] for i in place) for r in want.fetchall())
        return out

    return run


def test_bundle_name(rows):
    df = rows([(g,) for g in [*GENERATIONS, None]], "g long").select("g", fp.bundle_name(F.col("g"), "logs").alias("name"))
    found = {r.g: r.name for r in df.withColumn("back", fp.bundle_generation(F.col("name"), "logs")).filter("g IS NULL OR back = g").select("g", "name").collect()}
    assert found == {1: "logs.gen0001.zip", 42: "logs.gen0042.zip", 9999: "logs.gen9999.zip", 10000: "logs.gen10000.zip", 10001: "logs.gen10001.zip", 123456: "logs.gen123456.zip", None: None}


def test_sc12_beyond_four_digits(spark, check):
    assert {r[3] for r in check(spark, "sc12_bundle_generation")} == set(GENERATIONS)


def test_src03_beyond_four_digits(spark, check):
    assert {r[3] for r in check(spark, "src03_read_sidecars")} == set(GENERATIONS)


def test_win08_beyond_four_digits(spark, check):
    assert max(r[1] for r in check(spark, "win08_next_generation")) == 123457
