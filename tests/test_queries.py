"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexplane.plans.registry import ORACLE_SQL, QUERIES

SF = entry.SF
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(str(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rule_id", "years", "baseline", "compliant", "margin"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
