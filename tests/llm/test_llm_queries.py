import glob
import os

import duckdb
import pytest

from convolens.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    got = df.select(*sorted(df.columns)).collect()
    if name in ORACLE:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        r = c.execute(ORACLE[name])
        names = [d[0] for d in r.description]
        at = [names.index(x) for x in sorted(names)]
        assert sorted(map(str, (tuple(x) for x in got))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_nothing_else_imports_it():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "convolens")
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in f.replace(os.sep, "/"):
            assert "convolens.llm" not in open(f).read()
