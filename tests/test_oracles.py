"""Each registered language query against DuckDB on the smallest tables, where these are present."""

import glob
import os

import pytest

from arbora import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x) -> str:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    return f"{float(x):.6f}"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    o = duck.sql(queries.oracle_sql()[name])
    names = list(o.columns)
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in o.fetchall())
