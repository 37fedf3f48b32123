"""Every registered query of the engine beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

from bagloom import workloads

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in workloads.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(norm(y) for y in x.values())
    return tuple(norm(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(workloads.QUERIES))
def test_same_rows(spark, oracle, name):
    df = workloads.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = oracle.execute(workloads.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want
