"""The queries that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from nightledger.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert names == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cursor.fetchall(), key=str)
