"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from axlewatch.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(row):
    out = []
    for x in row:
        if isinstance(x, bool) or x is None or isinstance(x, str):
            out.append(str(x))
        else:
            out.append(f"{float(x):.9g}")
    return tuple(out)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(plain([r[c] for c in columns]) for r in got.collect())
    b = sorted(plain([r[i] for i in at]) for r in want.fetchall())
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 0
