"""Loop programs: rules of the language that the registered queries don't show."""

import pytest

from bagloom.api import Session
from bagloom.lang.tree import QueryError
from bagloom.plans.loops import run_loops
from bagloom.plans.sql import run_sql


@pytest.fixture(params=[run_loops, run_sql], ids=["plans", "sql"])
def run(spark, request):
    def go(text, **bound):
        out = request.param(text, {"spark": spark, **bound}, Session())
        return {k: sorted(tuple(r) for r in v.collect()) if hasattr(v, "collect") else v for k, v in out.items()}

    return go


def test_missing_cells_drop_iterations(run, spark):
    a = spark.createDataFrame([(1, 10.0), (3, 30.0)], "i long, v double")
    assert run("var R: vector[Double] = vector(); for i = 0, 5 do R[i] := A[i] * 2.0;", A=a)["R"] == [(1, 20.0), (3, 60.0)]


def test_stepped_and_scaled_indices(run, spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(12)], "i long, v double")
    assert run("var R: vector[Double] = vector(); for i = 1, 9, 3 do R[i] := A[i];", A=a)["R"] == [(1, 1.0), (4, 4.0), (7, 7.0)]
    assert run("var R: vector[Double] = vector(); for i = 0, 4 do R[i] := A[i*2];", A=a)["R"] == [(i, 2.0 * i) for i in range(5)]
    assert run("var R: vector[Double] = vector(); for i = 0, 4 do R[i] := A[10-i];", A=a)["R"] == [(i, 10.0 - i) for i in range(5)]


def test_increments_meet_old_cells(run, spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i long, v double")
    got = run("for i = 2, 3 do A[i] += 10.0; for i = 1, 1 do A[i] *= 5.0;", A=a)
    assert got["A"] == [(1, 5.0), (2, 12.0), (3, 10.0)]


def test_conditions_and_else(run, spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(4)], "i long, v double")
    got = run("var x: Double = 0.0; var y: Double = 0.0; for i = 0, 3 do if (A[i] > 1.0) x += A[i]; else y += A[i]; if (x > y) x := 0.0 - x;", A=a)
    assert (got["x"], got["y"]) == (-5.0, 1.0)


def test_while_and_scalars(run):
    got = run("var i: Int = 0; var s: Long = 0L; while (i < 5) { i += 1; s += i * i; }; var h: Int = s / 2;")
    assert (got["i"], got["s"], got["h"]) == (5, 55, 27)


def test_group_by_is_dropped_for_whole_keys(spark):
    a = spark.createDataFrame([(1, 1.0)], "i long, v double")
    out = run_sql("var R: vector[Double] = vector(); for i = 0, 9 do R[i] += A[i];", {"spark": spark, "A": a}, Session())
    assert "GROUP BY" not in out["sql"][-1] and "JOIN" not in out["sql"][-1]
    out = run_sql("var R: vector[Double] = vector(); for i = 0, 9 do R[i] := A[i] * A[i];", {"spark": spark, "A": a}, Session())
    assert out["sql"][-1].count("view_") == 1  # one scan for equal reads


def test_printed(run, spark):
    a = spark.createDataFrame([(1, 1.0)], "i long, v double")
    assert run("println(1 + 2); A.foreach(println);", A=a)["printed"][0] == 3


@pytest.mark.parametrize("text", ["for i = 0, 3 do i := 2;", "var x: Int = 0; for i = 0, 3 do x := i;", "return 3;", "var A: vector[Int] = vector(); for i = 0, 3 do B[i] := A[i];", "var x: Int = ;", "for i = 0, 3 do { x += 1 "])
def test_errors(run, text):
    with pytest.raises(QueryError):
        run(text)


def test_defaults_and_literals(spark):
    a = spark.createDataFrame([(1, 10.0), (3, 30.0)], "i long, v double")
    out = run_loops("var R: vector[Double] = vector(); for i = 0, 3 do R[i] := (A[i] : 0.5) * 2.0; var H: vector[Boolean] = vector(); for i = 0, 3 do H[i] := exists(A[i]); var M: matrix[Double] = matrix(((0,1),2.0),((1,1),3.0)); M[1,1] += 1.0;", {"spark": spark, "A": a}, Session())
    rows = lambda n: sorted(map(tuple, out[n].collect()))
    assert rows("R") == [(0, 1.0), (1, 20.0), (2, 1.0), (3, 60.0)]
    assert rows("H") == [(0, False), (1, True), (2, False), (3, True)]
    assert rows("M") == [(0, 1, 2.0), (1, 1, 4.0)]
