"""The operators that SQL can express, against DuckDB on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from mercadia.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, res = QUERIES[key](spark, SF), con.sql(SQL[key])
    columns = sorted(df.columns)
    assert columns == sorted(res.columns)
    want = res.df()[columns].astype(object).where(lambda d: d.notna(), None)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(
        None if v is None else type(g)(v) if g is not None else v for v, g in zip(r, got[0])))
        for r in want.itertuples(index=False))


def test_all_queries_are_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {"pipeline"} | set(QUERIES) <= names and len(QUERIES) == 13
