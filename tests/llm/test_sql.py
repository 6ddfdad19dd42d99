"""The training-data queries that SQL can say, against DuckDB."""

import os

import duckdb
import pytest

from lodeframe.llm.queries import llm_oracle_sql, llm_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")


def keys(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_matches_sql(spark, name):
    duck, said = duckdb.connect(), llm_oracle_sql()[name]
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = llm_queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(duck.sql(said).columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert keys(df.select(*columns).collect()) == keys(duck.sql(f"SELECT {listed} FROM ({said})").fetchall())
