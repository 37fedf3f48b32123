"""Physical plans that matter at scale."""

import pytest

from bagloom.api import Session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    def go(text):
        bound = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "customer", "lineitem", "nation")}
        df = Session().q(text, spark=spark, **bound)
        return df._jdf.queryExecution().executedPlan().toString()

    return go


def test_scan_reads_and_filters_only_what_is_needed(plan):
    p = plan("select o.o_orderkey from o <- orders where o.o_totalprice > 300000.0")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p and "GreaterThan(o_totalprice,300000.0)" in p and "Exchange" not in p


def test_group_by_has_one_exchange_after_a_partial_aggregate(plan):
    p = plan("select (f, +/l.l_quantity, avg/l.l_tax, count/l) from l <- lineitem group by f: l.l_returnflag")
    assert p.count("Exchange hashpartitioning") == 1 and "partial_sum" in p


def test_joins_are_no_products(plan):
    for text in ("select (o.o_orderkey, c.c_name) from o <- orders, c <- customer where o.o_custkey == c.c_custkey", "select (c.c_name, +/(select o.o_totalprice from o <- orders where o.o_custkey == c.c_custkey)) from c <- customer", "select (o, c, n) from o <- orders, n <- nation, c <- customer where o.o_custkey == c.c_custkey && c.c_nationkey == n.n_nationkey"):
        p = plan(text)
        assert "Cartesian" not in p and "NestedLoop" not in p


def test_nested_sum_aggregates_before_the_join(plan):
    p = plan("select (c.c_name, +/(select o.o_totalprice from o <- orders where o.o_custkey == c.c_custkey)) from c <- customer")
    assert p.index("Join") < p.index("Aggregate") and ("LeftOuter" in p or "RightOuter" in p)


def test_quantifiers_are_semi_and_anti_joins(plan):
    assert "LeftSemi" in plan("select c.c_name from c <- customer where some o <- orders: o.o_custkey == c.c_custkey")
    assert "LeftAnti" in plan("select c.c_name from c <- customer where all o <- (select o from o <- orders where o.o_custkey == c.c_custkey): o.o_totalprice < 1.0")


def test_no_python_in_any_engine_plan(plan):
    for text in ("select (i, +/(select x * 2.0 from x <- List(1.0, 2.0) where x > 1.0)) from n <- nation, i = n.n_nationkey", "select (k, count/o) from o <- orders group by k: o.o_custkey % 7"):
        assert "Python" not in plan(text) and "Arrow" not in plan(text)
