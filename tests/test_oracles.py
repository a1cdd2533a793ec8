"""Every query with SQL against DuckDB on the smallest data; skipped where the data is absent."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tracelake.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = sorted(registry.oracle_sql())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    fmt = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(fmt(v) for _, v in sorted(zip(cols, row))) for row in r.fetchall())
    df = registry.queries()[name](spark, DATA)
    got = sorted(tuple(fmt(row[k]) for k in sorted(df.columns)) for row in df.collect())
    assert sorted(cols) == sorted(df.columns) and got == want
