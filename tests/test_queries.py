"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from pagelake.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame):
    names = sorted(frame.columns)

    def value(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(str([value(v) for v in row]) for row in frame[names].astype(object).where(frame[names].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns)
    if name in core.ORACLE_SQL:
        want = duck.sql(core.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
