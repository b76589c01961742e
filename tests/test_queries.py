"""Every query with SQL gives the same rows as DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from convolens.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None:
        return "-"
    if isinstance(v, float):
        return "%.6g" % v
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr([norm(x) for x in r]) for r in df.select(*cols).collect())
    if name in registry.ORACLE:
        r = duck.execute(registry.ORACLE[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr([norm(row[i]) for i in at]) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES)
