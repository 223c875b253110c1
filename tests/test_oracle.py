"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["check_id", "n"] and df.count() > 0


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    rows = df.collect()
    sql = oracle_sql().get(key)
    if sql is None:
        assert isinstance(rows, list)
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    cols = sorted(df.columns)
    s = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in rows)
    idx = [dcols.index(c) for c in cols]
    d = Counter(repr(tuple(norm(r[i]) for i in idx)) for r in res.fetchall())
    assert s == d
