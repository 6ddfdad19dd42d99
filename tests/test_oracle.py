"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import lodeframe.queries_files  # noqa: F401
from lodeframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for file in os.listdir(SF):
        out.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return out


def keys(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert keys(df.select(*columns).collect()) == keys(duck.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    stream = {tuple(r) for r in QUERIES["stream_dedup"](spark, SF).collect()}
    assert stream == {tuple(r) for r in QUERIES["carried_dedup"](spark, SF).collect()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
