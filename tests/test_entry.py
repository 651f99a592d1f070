"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tracefold.plans.log_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    spark.catalog.clearCache()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    else:
        assert got


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
