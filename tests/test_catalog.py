"""Every registered query of the core against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lodestar.plans import every

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def told(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(every.QUERIES))
def test_query(spark, con, name):
    df = every.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(told(r[c]) for c in cols) for r in df.collect())
    if name not in every.SQL:
        assert mine
        return
    cur = con.execute(every.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine
    assert mine == sorted(tuple(told(r[i]) for i in at) for r in cur.fetchall())
