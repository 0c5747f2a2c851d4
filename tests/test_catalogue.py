"""Each registered query against its SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

HERE = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{HERE}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, HERE)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    theirs = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
