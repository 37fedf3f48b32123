"""Sums of products: packed rows where pairs meet often, a join elsewhere, the same cells either way."""

import random

import pytest

from bagloom.api import Session
from bagloom.operators.bags import multiply, multiply_grid
from bagloom.plans.loops import run_loops
from bagloom.plans.sql import run_sql

PRODUCT = "select (i, k, +/z) from (i, j, x) <- M, (l, k, y) <- N, z = x * y where j == l group by (i, k)"
CELLS = "var R: matrix[Double] = matrix(); for i = 0, 9 do for j = 0, 11 do { R[i,j] := 1.0; for k = 0, 99 do R[i,j] += M[i,k] * N[k,j]; };"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def matrices(spark, inner, share, rows=8, columns=9):
    rng = random.Random(inner)
    a = [(i, j, float(rng.randint(-9, 9))) for i in range(rows) for j in range(inner) if rng.random() < share]
    b = [(j, k, float(rng.randint(-9, 9))) for k in range(columns) for j in range(inner) if rng.random() < share]
    a += a[:3]  # cells may come twice
    want = {}
    for i, j, x in a:
        for l, k, y in b:
            if j == l:
                want[i, k] = want.get((i, k), 0.0) + x * y
    kind = "i long, j long, v double"
    return spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), want


def cells(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


@pytest.mark.parametrize("inner, share", [(40, 0.9), (100, 0.5), (12, 0.45)])
def test_grid_of_packed_rows_exchanges_no_sum(spark, inner, share):
    m, n, want = matrices(spark, inner, share)
    for df in (multiply_grid(m, n, 2, 2), multiply(m, n)):
        top = plan(df).split("CartesianProduct")
        assert len(top) == 2 and "Exchange" not in top[0]
        assert cells(df) == want


def test_sparse_and_odd_products_stay_joins(spark):
    sparse = [(i, i, 1.0) for i in range(50)]
    eye = spark.createDataFrame(sparse, "i long, j long, v double")
    assert cells(multiply(eye, eye)) == {(i, i): 1.0 for i in range(50)} and "Cartesian" not in plan(multiply(eye, eye))
    m, n, want = matrices(spark, 5, 0.9, 3, 3)
    holes = m.union(spark.createDataFrame([(7, 0, None)], m.schema))
    assert {k: v for k, v in cells(multiply(holes, n)).items() if k[0] != 7} == want and "Cartesian" not in plan(multiply(holes, n))


def test_comprehension_pairs_packed_rows(spark):
    m, n, want = matrices(spark, 40, 0.9)
    df = Session().q(PRODUCT, spark=spark, M=m, N=n)
    assert "CartesianProduct" in plan(df) and cells(df) == want
    assert "Cartesian" not in plan(Session().q(PRODUCT.replace("x * y", "x + y"), spark=spark, M=m, N=n))
    swapped = Session().q("select (+/z, k, i) from (i, j, x) <- M, (l, k, y) <- N, z = y * x where l == j && i > 2 group by (k, i)", spark=spark, M=m, N=n)
    assert "CartesianProduct" in plan(swapped) and {(r[2], r[1]): r[0] for r in swapped.collect()} == {k: v for k, v in want.items() if k[0] > 2}


@pytest.mark.parametrize("run", [run_loops, run_sql])
def test_loops_fill_and_add_without_a_join_of_cells(spark, run):
    m, n, want = matrices(spark, 40, 0.9)
    df = run(CELLS, {"spark": spark, "M": m, "N": n}, Session())["R"]
    assert "CartesianProduct" in plan(df) and "FullOuter" not in plan(df)
    assert cells(df) == {(i, j): 1.0 + want.get((i, j), 0.0) for i in range(10) for j in range(12)}
    narrow = CELLS.replace("R[i,j] := 1.0; for k", "R[i,j] := 1.0; }; for i = 2, 4 do for j = 0, 20 do { for k")
    assert cells(run(narrow, {"spark": spark, "M": m, "N": n}, Session())["R"]) == {(i, j): 1.0 + (want.get((i, j), 0.0) if 2 <= i <= 4 else 0.0) for i in range(10) for j in range(12)}
