"""Queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from pagelake.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = llm.QUERIES[name](spark, sf_dir).toPandas(), con.sql(llm.ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda f: sorted(str([None if v is None or v != v else int(v) if isinstance(v, float) else v for v in r]) for r in f[names].astype(object).where(f[names].notna(), None).values.tolist())
    assert rows(got) == rows(want)
