"""Queries with SQL against DuckDB, whole tables at the smallest scale."""
import duckdb
import pytest

from tests.llm.conftest import SF
from tuplespark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()))
    assert got == want and got
