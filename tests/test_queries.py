"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from holdfast.plans.queries import QUERIES, SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert got
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == cols
        at = [found.columns.index(c) for c in cols]
        want = [tuple(x[i] for i in at) for x in found.fetchall()]
        key = lambda x: tuple(map(str, map(plain, x)))
        assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
