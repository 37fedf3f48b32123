"""Registered queries of the engine's own operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagloom.sources.scans import known

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Lazy(dict):
    """Tables by name, read when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self[name]

    def named(self, text: str) -> dict[str, DataFrame]:
        import re

        return {t: self[t] for t in TABLES if re.search(rf"\b{t}\b", text)}


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(name: str, text: str, columns: str, sql: str, places: int | None = 4, **extra: Any) -> None:
    """Registers a comprehension; columns names its output."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from bagloom.api import Session

        session = Session()
        for macro in extra.get("macros", ()):
            session.m(macro)
        for m in extra.get("monoids", ()):
            session.monoid(*m())
        t = Lazy(spark, sf_dir)
        bound = t.named(text + " ".join(extra.get("macros", ()))) | {k: (v(t) if callable(v) and getattr(v, "__name__", "") == "<lambda>" else v) for k, v in extra.get("bind", {}).items()}
        out = session.q(text, spark=spark, **bound)
        out = out.toDF(*columns.split()) if columns else out
        return rounded(out, places) if places is not None else out

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def program(name: str, text: str, result: str, sql: str, bind: Callable[[Lazy], dict[str, Any]], columns: str = "", places: int = 4, twin: bool = True, monoids: tuple = (), sql_name: str | None = None) -> None:
    """Registers a loop program under loop_<name> and its generated-SQL twin under sql_<name>; result is a variable, or several scalars."""

    def runner(engine: str) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from bagloom.api import Session
            from bagloom.plans.loops import run_loops
            from bagloom.plans.sql import run_sql

            session = Session()
            for m in monoids:
                session.monoid(*m())
            found = (run_loops if engine == "loop" else run_sql)(text, {"spark": spark, **bind(Lazy(spark, sf_dir))}, session)
            names = result.split()
            if isinstance(found[names[0]], DataFrame):
                out = found[names[0]]
            else:
                out = spark.createDataFrame([tuple(found[n] for n in names)], names)
            out = out.toDF(*columns.split()) if columns else out
            return rounded(out, places)

        return run

    QUERIES[f"loop_{name}"], ORACLE_SQL[f"loop_{name}"] = runner("loop"), sql
    if twin:
        QUERIES[f"sql_{name}"], ORACLE_SQL[f"sql_{name}"] = runner("sql"), sql


# ---- projection, filter, patterns ----
query("select_project_filter", "select (o.o_orderkey, o.o_totalprice * 2.0) from o <- orders where o.o_totalprice < 50000.0", "k p", "SELECT o_orderkey AS k, round(o_totalprice * 2, 4) AS p FROM orders WHERE o_totalprice < 50000")
query("select_distinct", "select distinct (o.o_orderpriority, o.o_orderstatus) from o <- orders", "p s", "SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders")
query("pattern_literal_filter", 'select (k, p) from (k, c, "F", p, d, pr) <- orders', "k p", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders WHERE o_orderstatus = 'F'")
query("pattern_named", "select (n, r.r_name) from n0@(n, name, k) <- nation, r <- region where n0.n_regionkey == r.r_regionkey", "n r", "SELECT n_nationkey AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
query("let_binding", "select (l.l_orderkey, l.l_linenumber, net) from l <- lineitem, net = l.l_extendedprice * (1.0 - l.l_discount) where net > 50000.0", "k n net", "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
query("unnest_generator", "select (e.vec_id, +/x) from e <- embeddings, x <- e.embedding group by k: e.vec_id".replace("(e.vec_id, +/x)", "(k, +/x)"), "k s", "SELECT vec_id AS k, round(sum(CAST(x AS DOUBLE)), 3) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id", 3)
query("nested_bag_reduce", "select (e.vec_id, max/e.embedding, count/e.embedding) from e <- embeddings", "k m n", "SELECT vec_id AS k, round(list_max(embedding)::DOUBLE, 4) AS m, len(embedding)::BIGINT AS n FROM embeddings")
query("array_select_filter", "select (e.vec_id, count/(select x from x <- e.embedding where x > 0.0)) from e <- embeddings", "k n", "SELECT vec_id AS k, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n FROM embeddings")
query("array_quantifiers", "select e.vec_id from e <- embeddings where (some x <- e.embedding: x > 0.4) && (all x <- e.embedding: x < 0.9)", "k", "SELECT vec_id AS k FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.4)) > 0 AND len(list_filter(embedding, lambda x: NOT x < 0.9)) = 0")
query("match_cases", 'select (o.o_orderkey, o.o_orderpriority match { case "1-URGENT" => 1 case p by p < "4" => 2 case _ => 3 }) from o <- orders', "k c", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority < '4' THEN 2 ELSE 3 END AS c FROM orders")
query("if_else", 'select (c.c_custkey, if (c.c_acctbal < 0.0) "debt" else "credit") from c <- customer', "k s", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS s FROM customer")
query("record_head", "select <key = o.o_orderkey, year = year(o.o_orderdate)> from o <- orders", "", "SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
query("lambda_map", "select k from k <- orders.map(o => o.o_custkey * 2).filter(x => x % 3 == 0)", "k", "SELECT o_custkey * 2 AS k FROM orders WHERE (o_custkey * 2) % 3 = 0")
query("let_in", "let big = (select o from o <- orders where o.o_totalprice > 300000.0) in select (b.o_orderkey, c.c_name) from b <- big, c <- customer where b.o_custkey == c.c_custkey", "k n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
query("integer_division", "select (o.o_orderkey, (0 - o.o_orderkey) / 7, o.o_orderkey % 7) from o <- orders", "k q r", "SELECT o_orderkey AS k, CAST(trunc(-o_orderkey / 7.0) AS BIGINT) AS q, o_orderkey % 7 AS r FROM orders")

# ---- order ----
query("order_by_multi", "select (n.n_regionkey, n.n_name) from n <- nation order by (n.n_regionkey desc, n.n_name)", "r n", "SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2")
query("order_by_take", "(select (o.o_orderkey, o.o_totalprice) from o <- orders order by (o.o_totalprice desc, o.o_orderkey)).take(10)", "k p", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
query("order_distinct", "select distinct c.c_mktsegment from c <- customer order by c.c_mktsegment desc", "s", "SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY 1 DESC")

# ---- grouping ----
query("group_sum", "select (f, +/q, count/q) from l <- lineitem, q = l.l_quantity group by f: l.l_returnflag", "f s n", "SELECT l_returnflag AS f, round(sum(l_quantity), 4) AS s, count(*) AS n FROM lineitem GROUP BY 1")
query("group_having", "select (k, +/p) from o <- orders, p = o.o_totalprice group by k: o.o_custkey having count/o > 12", "k s", "SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 HAVING count(*) > 12", 2)
query("group_order", "select (s, max/p) from o <- orders, p = o.o_totalprice group by s: o.o_orderstatus order by max/p", "s m", "SELECT o_orderstatus AS s, round(max(o_totalprice), 4) AS m FROM orders GROUP BY 1 ORDER BY 2")
query("group_tuple_multi_agg", "select (f, s, +/l.l_quantity, avg/l.l_extendedprice, min/l.l_discount, max/l.l_tax, count/l) from l <- lineitem group by (f, s): (l.l_returnflag, l.l_linestatus)", "f s q a mi ma n", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS a, round(min(l_discount), 2) AS mi, round(max(l_tax), 2) AS ma, count(*) AS n FROM lineitem GROUP BY 1, 2", 2)
query("group_conditional", "select (p, count/(select x from x <- o where x.o_totalprice > 100000.0), +/(select x.o_totalprice from x <- o where x.o_orderstatus == \"F\")) from o <- orders group by p: o.o_orderpriority", "p n s", "SELECT o_orderpriority AS p, count(*) FILTER (o_totalprice > 100000) AS n, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS s FROM orders GROUP BY 1", 2)
query("group_lifted_bag", "select (r, n) from (k, n, r) <- nation group by r".replace("(r, n)", "(r, count/n, n.sorted)"), "r c names", "SELECT n_regionkey AS r, count(*) AS c, list_sort(list(n_name)) AS names FROM nation GROUP BY 1", None)
query("group_computed_key", "select (m, count/l) from l <- lineitem group by m: l.l_quantity.toInt / 10", "m n", "SELECT CAST(trunc(CAST(l_quantity AS INTEGER) / 10) AS INTEGER) AS m, count(*) AS n FROM lineitem GROUP BY 1")
query("distinct_group", "select s from o <- orders group by s: (o.o_orderstatus, o.o_orderpriority)".replace("select s from", "select (s._1, s._2) from"), "a b", "SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders")

# ---- totals ----
query("total_avg", "avg/(select o.o_totalprice from o <- orders where o.o_orderstatus == \"F\")", "a", "SELECT round(avg(o_totalprice), 2) AS a FROM orders WHERE o_orderstatus = 'F'", 2)
query("total_count", "count/lineitem", "n", "SELECT count(*) AS n FROM lineitem")
query("total_max", "(max/(select o.o_totalprice from o <- orders), min/(select o.o_totalprice from o <- orders))", "a b", "SELECT round(max(o_totalprice), 4) AS a, round(min(o_totalprice), 4) AS b FROM orders")
query("total_and", "(&&/(select l.l_quantity > 0.0 from l <- lineitem), ||/(select l.l_tax > 0.5 from l <- lineitem))", "a b", "SELECT bool_and(l_quantity > 0) AS a, bool_or(l_tax > 0.5) AS b FROM lineitem")
query("total_empty", "(+/(select o.o_totalprice from o <- orders where o.o_totalprice < 0.0), count/(select o from o <- orders where o.o_totalprice < 0.0))", "s n", "SELECT coalesce(sum(o_totalprice), 0)::DOUBLE AS s, count(*) AS n FROM orders WHERE o_totalprice < 0")
query("exists_total", "some o <- orders: o.o_totalprice > 500000.0", "b", "SELECT bool_or(o_totalprice > 500000) AS b FROM orders")
query("forall_total", "all l <- lineitem: l.l_discount <= 0.1", "b", "SELECT bool_and(l_discount <= 0.1) AS b FROM lineitem")

# ---- joins ----
query("equi_join", "select (o.o_orderkey, c.c_name) from o <- orders, c <- customer where o.o_custkey == c.c_custkey", "k n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey")
query("multi_key_join", "select (a.l_orderkey, b.l_linenumber) from a <- lineitem, b <- lineitem where a.l_orderkey == b.l_orderkey && a.l_linenumber + 1 == b.l_linenumber", "k n", "SELECT a.l_orderkey AS k, b.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber")
query("broadcast_join", "select (c.c_custkey, n.n_name) from c <- customer, n <-- nation where c.c_nationkey == n.n_nationkey", "k n", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
query("broadcast_join_filtered", 'select (s.s_suppkey, n.n_name) from s <- supplier, n <-- nation where s.s_nationkey == n.n_nationkey && s.s_acctbal > 0.0 && n.n_regionkey == 1', "k n", "SELECT s_suppkey AS k, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 AND n_regionkey = 1")
query("pattern_join", "select (o.o_orderkey, d._2) from o <- orders, d@(ck, cn, nk, b, s) <- customer where o.o_custkey == ck && nk == 3", "k n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
query("local_join", "select (n.n_name, x) from x <- List(1, 3, 5), n <- nation where n.n_nationkey == x", "n x", "SELECT n_name AS n, n_nationkey AS x FROM nation WHERE n_nationkey IN (1, 3, 5)")
query("local_cross", "select (r.r_name, x) from r <- region, x <- (1 to 3).toList", "r x", "SELECT r_name AS r, x::BIGINT AS x FROM region, range(1, 4) t(x)")
query("theta_join", "select (a.n_name, b.n_name) from a <- nation, b <- nation where a.n_regionkey == b.n_regionkey && a.n_nationkey < b.n_nationkey", "a b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
query("cross_product", "select (a.r_name, b.r_name) from a <- region, b <- region", "a b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
query("multiway_join_3", "select (c.c_name, n.n_name, r.r_name) from c <- customer, n <- nation, r <- region where c.c_nationkey == n.n_nationkey && n.n_regionkey == r.r_regionkey", "c n r", "SELECT c_name AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
query("multiway_join_4", "select (r, +/o.o_totalprice) from rr <- region, n <- nation, c <- customer, o <- orders where rr.r_regionkey == n.n_regionkey && n.n_nationkey == c.c_nationkey && c.c_custkey == o.o_custkey group by r: rr.r_name", "r s", "SELECT r_name AS r, round(sum(o_totalprice), 2) AS s FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1", 2)
query("join_cross_mix", "select (n.n_name, r.r_name, x) from n <- nation, r <- region, x <- List(1, 2) where n.n_regionkey == r.r_regionkey", "n r x", "SELECT n_name AS n, r_name AS r, x FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (1), (2)) t(x)")
query("join_pushdown", 'select (o.o_orderkey, c.c_name) from o <- orders, c <- customer where o.o_custkey == c.c_custkey && c.c_mktsegment == "BUILDING" && o.o_totalprice > 200000.0', "k n", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
query("join_then_group", "select (b, +/l.l_extendedprice) from l <- lineitem, p <- part where l.l_partkey == p.p_partkey group by b: p.p_brand", "b s", "SELECT p_brand AS b, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", 2)
query("semi_join_some", "select c.c_custkey from c <- customer where some o <- orders: o.o_custkey == c.c_custkey && o.o_totalprice > 250000.0", "k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
query("anti_join_all", "select c.c_custkey from c <- customer where all o <- (select o from o <- orders where o.o_custkey == c.c_custkey): o.o_totalprice < 250000.0", "k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < 250000)")
query("not_some", "select n.n_name from n <- nation where !(some s <- supplier: s.s_nationkey == n.n_nationkey)", "n", "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
query("member", "select c.c_custkey from c <- customer where c.c_nationkey member (select s.s_nationkey from s <- supplier where s.s_acctbal > 5000.0)", "k", "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")

# ---- nested queries ----
query("nested_bag_theta", "select (r.r_name, count/(select n.n_name from n <- nation where n.n_regionkey < r.r_regionkey)) from r <- region", "r n", "SELECT r_name AS r, (SELECT count(*) FROM nation WHERE n_regionkey < r_regionkey) AS n FROM region")
query("nested_sum_theta", "select (r.r_name, +/(select n.n_nationkey from n <- nation where n.n_regionkey <= r.r_regionkey)) from r <- region", "r s", "SELECT r_name AS r, (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey <= r_regionkey) AS s FROM region")
query("nested_sum_correlated", 'select (c.c_custkey, +/(select o.o_totalprice from o <- orders where o.o_custkey == c.c_custkey && o.o_orderstatus == "P")) from c <- customer', "k s", "SELECT c_custkey AS k, round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), 0), 2) AS s FROM customer", 2)
query("correlated_agg_filter", "select c.c_name from c <- customer where c.c_acctbal * 300.0 < +/(select o.o_totalprice from o <- orders where o.o_custkey == c.c_custkey)", "n", "SELECT c_name AS n FROM customer WHERE c_acctbal * 300 < coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0)")
query("two_level_nested_agg", "select (k, +/t) from c <- customer, t = +/(select o.o_totalprice from o <- orders where o.o_custkey == c.c_custkey && o.o_totalprice > avg/(select p.o_totalprice from p <- orders where p.o_custkey == o.o_custkey)) group by k: c.c_custkey % 10", "k s", "SELECT c_custkey % 10 AS k, round(sum(t), 2) AS s FROM (SELECT c_custkey, coalesce((SELECT sum(o_totalprice) FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS a FROM orders) WHERE o_custkey = c_custkey AND o_totalprice > a), 0) AS t FROM customer) GROUP BY 1", 2)
query("deep_correlation", "select (r.r_name, +/(select count/(select c from c <- customer where c.c_nationkey == n.n_nationkey && c.c_acctbal > r.r_regionkey * 1000.0) from n <- nation where n.n_regionkey == r.r_regionkey)) from r <- region", "r n", "SELECT r_name AS r, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > r_regionkey * 1000 GROUP BY r_name")
query("nested_group_flat", "select (c.c_custkey, g._1, g._2) from c <- customer, g <- (select (o.o_custkey, s, n) from (k, s, n) <- (select (k, s, count/o) from o <- orders group by (k, s): (o.o_custkey, o.o_orderstatus)), o <- List(<o_custkey = 1>) where k == c.c_custkey)".replace("g <- (select (o.o_custkey, s, n) from (k, s, n) <- (select (k, s, count/o) from o <- orders group by (k, s): (o.o_custkey, o.o_orderstatus)), o <- List(<o_custkey = 1>) where k == c.c_custkey)", "(k, s, n) <- (select (k, s, count/o) from o <- orders group by (k, s): (o.o_custkey, o.o_orderstatus)) where k == c.c_custkey").replace("g._1, g._2", "s, n"), "k s n", "SELECT c_custkey AS k, o_orderstatus AS s, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
query("uncorrelated_scalar", "select o.o_orderkey from o <- orders where o.o_totalprice > 2.0 * avg/(select p.o_totalprice from p <- orders)", "k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders)")
query("nested_head_minby", "select (n.n_name, (select s.s_name from s <- supplier where s.s_nationkey == n.n_nationkey order by (s.s_acctbal desc, s.s_suppkey desc)).head) from n <- nation", "n s", "SELECT n_name AS n, (SELECT arg_max(s_name, (s_acctbal, s_suppkey)) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation")
query("nested_group_key", "select (b, count/p) from p <- part group by b: (count/(select x from x <- List(5, 10, 25, 40) where x < p.p_size))", "b n", "SELECT CAST((5 < p_size)::INT + (10 < p_size)::INT + (25 < p_size)::INT + (40 < p_size)::INT AS BIGINT) AS b, count(*) AS n FROM part GROUP BY 1")
query("composite_nested", "select (n.n_nationkey, z._2, count/c) from n <- nation, c <- customer, z <- (select (k, +/s.s_acctbal) from s <- supplier group by k: s.s_nationkey) where c.c_nationkey == n.n_nationkey && z._1 == n.n_nationkey && (some o <- orders: o.o_custkey == c.c_custkey && o.o_totalprice > 200000.0) group by (nk, t): (n.n_nationkey, z._2)".replace("(n.n_nationkey, z._2, count/c) from", "(nk, t, count/c) from"), "k t n", "SELECT n_nationkey AS k, round(t, 2) AS t, count(*) AS n FROM nation JOIN customer c ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, sum(s_acctbal) AS t FROM supplier GROUP BY 1) z ON s_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1, 2", 2)

# ---- bag operations ----
query("union_bag", "(select c.c_nationkey from c <- customer) union (select s.s_nationkey from s <- supplier)", "k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
query("intersect_bag", "(select c.c_nationkey from c <- customer) intersect (select s.s_nationkey from s <- supplier)", "k", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
query("minus_bag", "(select c.c_nationkey from c <- customer) minus (select s.s_nationkey from s <- supplier)", "k", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
query("cogroup_diff", "select (k, count/c, count/s, +/b - +/a) from (ck, c, k, b, seg) <- customer group by k from (sk, s, k2, a) <- supplier group by k2", "k c s d", "SELECT coalesce(x.k, y.k) AS k, coalesce(c, 0) AS c, coalesce(s, 0) AS s, round(coalesce(b, 0) - coalesce(a, 0), 2) AS d FROM (SELECT c_nationkey AS k, count(*) AS c, sum(c_acctbal) AS b FROM customer GROUP BY 1) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS s, sum(s_acctbal) AS a FROM supplier GROUP BY 1) y ON x.k = y.k", 2)

# ---- macros, monoids, functions, iteration ----
query("macro_query", "select (o.o_orderkey, o.o_totalprice) from o <- above(300000.0, orders)", "k p", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders WHERE o_totalprice > 300000", macros=("def above(low: Double, xs: Orders) = select o from o <- xs where o.o_totalprice > low",))
query("user_monoid_min", "select (k, least2/p) from o <- orders, p = o.o_totalprice group by k: o.o_orderstatus", "k m", "SELECT o_orderstatus AS k, round(min(o_totalprice), 4) AS m FROM orders GROUP BY 1", monoids=(lambda: ("least2", F.least, None, F.min),))
query("user_monoid_argmin", "select (k, m._2) from (k, m) <- (select (k, argmin/(select (x.o_totalprice, x.o_orderkey) from x <- o)) from o <- orders group by k: o.o_custkey)", "k o", "SELECT o_custkey AS k, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o FROM orders GROUP BY 1")
query("user_monoid_fold", "select (k, xor/q) from l <- lineitem, q = l.l_linenumber group by k: l.l_orderkey", "k x", "SELECT l_orderkey AS k, bit_xor(l_linenumber) AS x FROM lineitem GROUP BY 1", monoids=(lambda: ("xor", lambda a, b: a.bitwiseXOR(b), 0, None),))


def _net(price, discount):
    return price * (1 - discount)


query("user_function", "select (l.l_orderkey, l.l_linenumber, net(l.l_extendedprice, l.l_discount)) from l <- lineitem", "k n p", "SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * (1 - l_discount), 4) AS p FROM lineitem", bind={"net": _net})
query("repeat_limit", "repeat s = (select n.n_nationkey from n <- nation) step select x * 2 from x <- s limit 3", "k", "SELECT n_nationkey * 8 AS k FROM nation")
query("repeat_until", "repeat s = 1 step s * 3 until s > 50", "s", "SELECT 243 AS s")
query("repeat_tuple", "repeat (s, t) = (1, 1) step (t, s + t) limit 10", "s t", "SELECT 89 AS s, 144 AS t")


def _kmeans_sql(k: int) -> str:
    ctes = ["p AS (SELECT l_quantity AS x, l_discount * 500 AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)", "c0 AS (SELECT * FROM (VALUES (5.0::DOUBLE, 5.0::DOUBLE), (40.0, 10.0), (10.0, 40.0), (45.0, 45.0)) t(x, y))"]
    for i in range(1, k + 1):
        ctes.append(f"d{i} AS (SELECT p.x, p.y, p.n, arg_min(row(c.x, c.y), (sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)), c.x, c.y)) AS k FROM p, c{i - 1} c GROUP BY ALL)")
        ctes.append(f"c{i} AS (SELECT sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y FROM d{i} GROUP BY k)")
    return f"WITH {', '.join(ctes)} SELECT round(x, 5) AS x, round(y, 5) AS y FROM c{k}"


query("kmeans", "repeat centroids = List(<x = 5.0, y = 5.0>, <x = 40.0, y = 10.0>, <x = 10.0, y = 40.0>, <x = 45.0, y = 45.0>) step select <x = avg/px, y = avg/py> from l <- lineitem, px = l.l_quantity, py = l.l_discount * 500.0 group by k: (select c from c <- centroids order by sqrt(pow(px - c.x, 2) + pow(py - c.y, 2))).head limit 3", "x y", _kmeans_sql(3), 5)

MATRIX = "(SELECT l_suppkey AS i, l_partkey % 40 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(t: Lazy, rows: str = "l_suppkey", cols: str = "l_partkey % 40") -> DataFrame:
    return t["lineitem"].groupBy(F.expr(rows).alias("i"), F.expr(cols).alias("j")).agg(F.sum("l_quantity").alias("v"))


query("matrix_macros", "select (i, j, v) from (i, j, v) <- cadd(transpose(M), transpose(M))", "i j v", f"WITH m AS {MATRIX} SELECT j AS i, i AS j, round(2 * v, 2) AS v FROM m", 2, bind={"M": lambda t: _matrix(t)}, macros=("def transpose(X: Matrix) = select (j, i, v) from (i, j, v) <- X; def cadd(X: Matrix, Y: Matrix) = select (i, j, +/x + +/y) from (i, j, x) <- X group by (i, j) from (i_, j_, y) <- Y group by (i_, j_)",))
query("stock_trace", "select (n.n_name, trace(n.n_nationkey + 1)) from n <- nation", "n k", "SELECT n_name AS n, n_nationkey + 1 AS k FROM nation")


def _lineage(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from bagloom.api import Session
        from bagloom.lang.parsing import parse_query

        t = Lazy(spark, sf_dir)
        df = Session().lowering({"spark": spark, **t.named(text)}, lineage=True).run(parse_query(text))
        return df.select(F.col("_1").alias("k"), F.explode("lineage").alias("x")).select("k", F.col("x.source").alias("source"), F.coalesce(F.get_json_object("x.row", "$.n_nationkey"), F.get_json_object("x.row", "$.r_regionkey")).alias("id"))

    return run


QUERIES["lineage_join"] = _lineage("select (n.n_name, r.r_name) from n <- nation, r <- region where n.n_regionkey == r.r_regionkey")
ORACLE_SQL["lineage_join"] = "SELECT n_name AS k, 'nation' AS source, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT n_name, 'region', r_regionkey::VARCHAR FROM nation JOIN region ON n_regionkey = r_regionkey"
QUERIES["lineage_group"] = _lineage("select (r, count/n) from n <- nation group by r: n.n_regionkey")
ORACLE_SQL["lineage_group"] = "SELECT n_regionkey AS k, 'nation' AS source, n_nationkey::VARCHAR AS id FROM nation"


def debug_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.api import debug_all

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = debug_all("select (n.n_name, 1) from n <- nation where n.n_regionkey < 2", nation=nation, spark=spark)
    return out.select(F.get_json_object("row", "$.n_nationkey").alias("id"), "status")


QUERIES["lineage_erased"], ORACLE_SQL["lineage_erased"] = debug_all_query, "SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey < 2 THEN 'kept' ELSE 'erased' END AS status FROM nation"

# ---- loop programs, and their twins as generated SQL ----
_lines = lambda t: {"L": t["lineitem"]}
_orders = lambda t: {"O": t["orders"].select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))}
program("sum", "var s: Double = 0.0; for v in O do s += v;", "s", "SELECT round(sum(o_totalprice), 2) AS s FROM orders", _orders, places=2)
program("cond_sum", "var s: Double = 0.0; for l in L do if (l.l_quantity < 25.0) s += l.l_extendedprice;", "s", "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity < 25", _lines, places=2)
program("cond_count", "var n: Long = 0L; for l in L do if (l.l_quantity < 25.0 && l.l_discount > 0.05) n += 1L;", "n", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 25 AND l_discount > 0.05", _lines)
program("count", "var n: Long = 0L; for l in L do n += 1L;", "n", "SELECT count(*) AS n FROM lineitem", _lines)
program("avg", "var s: Double = 0.0; var n: Long = 0L; var a: Double = 0.0; for v in O do { s += v; n += 1L; }; a := s / n;", "a", "SELECT round(avg(o_totalprice), 4) AS a FROM orders", _orders)
program("equal_all", 'var eq: Boolean = true; for l in L do eq := eq && l.l_linestatus == "O";', "eq", "SELECT bool_and(l_linestatus = 'O') AS eq FROM lineitem", _lines)
program("eq_frequency", 'var a: Long = 0L; var b: Long = 0L; var same: Boolean = false; for l in L do { if (l.l_returnflag == "A") a += 1L; if (l.l_returnflag == "R") b += 1L; }; same := a == b;', "a b same", "SELECT count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'A') = count(*) FILTER (l_returnflag = 'R') AS same FROM lineitem", _lines)
program("group_by", "var C: vector[Double] = vector(); for l in L do C[l.l_suppkey] += l.l_quantity;", "C", "SELECT l_suppkey AS i, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1", _lines, places=2)
program("word_count", "var C: map[String, Long] = map(); for w in W do C[w] += 1L;", "C", "SELECT w AS k, count(*) AS v FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1", lambda t: {"W": t["documents"].select(F.explode(F.split("text", "\\s+")).alias("value")).filter("value <> ''")})
program("histogram", "var R: vector[Long] = vector(); for p in P do R[p.l_quantity.toLong] += 1L;", "R", "SELECT CAST(l_quantity AS BIGINT) AS i, count(*) AS v FROM lineitem GROUP BY 1", lambda t: {"P": t["lineitem"].select("l_quantity", "l_tax")})
program("string_match", "var C: map[String, Boolean] = map(); for w in W do for k in K do if (w == k) C[w] := true;", "C", "SELECT DISTINCT w AS k, true AS v FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w IN ('the', 'and', 'nowhere', 'que')", lambda t: {"W": t["documents"].select(F.explode(F.split("text", "\\s+")).alias("value")), "K": known(t.spark, [("the",), ("and",), ("nowhere",), ("que",)], ["value"])})
program("reverse_index", "var R: map[String, Long] = map(); for p in P do R[p.link] += 1L;", "R", "SELECT link AS k, count(*) AS v FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY 1", lambda t: {"P": t["pages"].select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link"))})
program("indexed_group", "var C: vector[Double] = vector(); for i = 0, n do C[V[i].K] += V[i].A;", "C", "SELECT o_custkey AS i, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1", lambda t: {"V": t["orders"].select(F.col("o_orderkey").alias("i"), F.struct(F.col("o_custkey").alias("K"), F.col("o_totalprice").alias("A")).alias("v")), "n": 100_000_000}, places=2)
program("group_by_join", "var W: vector[Double] = vector(); for i = 0, n do W[K[i]] += V[i];", "W", "SELECT o_custkey AS i, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1", lambda t: {"K": t["orders"].select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v")), "V": t["orders"].select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), "n": 100_000_000}, places=2)
program("matrix_add", "var R: matrix[Double] = matrix(); for i = 0, 99999999 do for j = 0, 39 do R[i,j] := M[i,j] + M[i,j];", "R", f"WITH m AS {MATRIX} SELECT i, j, round(2 * v, 2) AS v FROM m", lambda t: {"M": _matrix(t)}, places=2)
program("linear_regression", "var sx: Double = 0.0; var sy: Double = 0.0; var n: Double = 0.0; var mx: Double = 0.0; var my: Double = 0.0; var xx: Double = 0.0; var xy: Double = 0.0; var slope: Double = 0.0; var intercept: Double = 0.0; for p in P do { sx += p.x; sy += p.y; n += 1.0; }; mx := sx / n; my := sy / n; for p in P do { xx += (p.x - mx) * (p.x - mx); xy += (p.x - mx) * (p.y - my); }; slope := xy / xx; intercept := my - slope * mx;", "slope intercept", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem", lambda t: {"P": t["lineitem"].select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))})
ORACLE_SQL["loop_linear_regression"] = ORACLE_SQL["sql_linear_regression"] = ORACLE_SQL["loop_linear_regression"].replace("l_quantity), 3)", "l_quantity), 4)")
program("kmeans_closest", "var best: vector[(Double, Long)] = vector(); for i = 0, 99999999 do for j = 0, 2 do best[i] := best[i] ^ (Math.abs(P[i] - C[j]), j);", "best", "SELECT o_orderkey AS i, arg_min(j, (abs(o_totalprice - c), j))::BIGINT AS v FROM orders, (VALUES (0, 50000.0), (1, 150000.0), (2, 250000.0)) t(j, c) GROUP BY 1", lambda t: {"P": t["orders"].select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), "C": known(t.spark, [(0, 50000.0), (1, 150000.0), (2, 250000.0)], ["i", "v"])}, twin=False, monoids=(lambda: ("^", F.least, None, F.min),))
_run_closest = QUERIES["loop_kmeans_closest"]
QUERIES["loop_kmeans_closest"] = lambda spark, sf_dir: _run_closest(spark, sf_dir).select("i", F.col("v").getField("_2").alias("v"))

program("shifted_index", "var R: vector[Double] = vector(); for i = 2, 99999998 do R[i] := V[i+1] - V[i-1];", "R", "SELECT a.o_orderkey AS i, round(b.o_totalprice - c.o_totalprice, 2) AS v FROM (SELECT o_orderkey + 1 AS o_orderkey FROM orders) a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 JOIN orders c ON c.o_orderkey = a.o_orderkey - 1 WHERE a.o_orderkey >= 2", lambda t: {"V": t["orders"].select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))}, places=2)
program("update_wins", "var A: vector[Double] = vector(); for i = 1, 10 do A[i] := 1.0; for i = 5, 15 do A[i] := 2.0; for i = 1, 3 do A[i] += 0.5;", "A", "SELECT i, CASE WHEN i <= 3 THEN 1.5 WHEN i <= 4 THEN 1.0 ELSE 2.0 END::DOUBLE AS v FROM range(1, 16) t(i)", lambda t: {})
program("component_update", "var A: vector[(Double, Long)] = vector(); for l in L do A[l.l_linenumber] := (0.0, 0L); for l in L do { A[l.l_linenumber]#1 += l.l_quantity; A[l.l_linenumber]#2 += 1L; };", "A", "SELECT l_linenumber::BIGINT AS i, round(sum(l_quantity), 2) AS a, count(*) AS b FROM lineitem GROUP BY 1", _lines, twin=False, places=2)
_run_component = QUERIES["loop_component_update"]
QUERIES["loop_component_update"] = lambda spark, sf_dir: _run_component(spark, sf_dir).select("i", F.round(F.col("v").getField("_1"), 2).alias("a"), F.col("v").getField("_2").alias("b"))
program("functions", "def net(p: Double, d: Double): Double { var keep: Double = 1.0 - d; return p * keep; }; var s: Double = 0.0; for l in L do s += net(l.l_extendedprice, l.l_discount);", "s", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 0) AS s FROM lineitem", _lines, places=0, twin=False)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's rows by way of a stream: an incremental group-by over event files, drained once."""
    from bagloom.streaming.incremental import drained

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rounded(drained("select (t, count/e, +/e.value, max/e.value) from e <- events group by t: e.event_type", {"events": events, "spark": spark}).toDF("t", "n", "s", "m"), 2)


QUERIES["stream_group"], ORACLE_SQL["stream_group"] = _streamed, "SELECT event_type AS t, count(*) AS n, round(sum(value), 2) AS s, round(max(value), 2) AS m FROM events GROUP BY 1"


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.streaming.windows import windowed

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(windowed(events, "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")], ["event_type"]).select(F.col("start").cast("date").cast("string").alias("d"), "event_type", "n", "s"), 2)


QUERIES["event_windows"], ORACLE_SQL["event_windows"] = _tumbling, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.sources.scans import vector

    return vector(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name"), ["s_name"])


QUERIES["vector_index"], ORACLE_SQL["vector_index"] = _indexed, "SELECT row_number() OVER (ORDER BY s_name) - 1 AS i, s_name AS v FROM supplier"


query("range_generator", "select (i, count/(select n from n <- nation where n.n_nationkey < i)) from i <- (0 to 25)", "i n", "SELECT i, (SELECT count(*) FROM nation WHERE n_nationkey < i) AS n FROM range(0, 26) t(i)")
query("nest_group_count", "select (s, n) from (s, n) <- (select (s, count/o) from o <- orders group by s: o.o_custkey) where n > 10", "k n", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")

# ---- the same over the whole tables: no fold of ids, no subset of keys ----
GRAPH = "e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem)"


def _graph(t: Lazy) -> DataFrame:
    return t["lineitem"].select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("d")).distinct()


def _nodes(t: Lazy) -> DataFrame:
    return _graph(t).select(F.explode(F.array("s", "d")).alias("value")).distinct()


def _top(df: DataFrame, *columns: str) -> int:
    """The greatest id in any of the columns."""
    return max(df.agg(*(F.max(c) for c in columns)).first())


def _pagerank_sql(steps: int, nodes: str) -> str:
    ctes = [GRAPH, f"n AS ({nodes})", "k AS (SELECT count(*) AS k FROM n)", "o AS (SELECT s, count(*) AS c FROM e GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE / k AS r FROM n, k)"]
    for i in range(1, steps + 1):
        ctes.append(f"p{i} AS (SELECT e.d, sum(r / c) AS r FROM e JOIN o ON o.s = e.s JOIN r{i - 1} q ON q.id = e.s GROUP BY 1)")
        ctes.append(f"r{i} AS (SELECT n.id, 0.15 / k + 0.85 * coalesce(p.r, 0) AS r FROM k, n LEFT JOIN p{i} p ON p.d = n.id)")
    return f"WITH {', '.join(ctes)} SELECT id, round(r, 10) AS r FROM r{steps}"


query("pagerank", "let nodes = (select distinct x from x <- ((select s from (s, d) <- edges) union (select d from (s, d) <- edges))) in let N = count/nodes in repeat rank = (select (i, 1.0 / N) from i <- nodes) step select (i, 0.15 / N + 0.85 * (+/(select r / c from (s, d) <- edges, (k, r) <- rank, (q, c) <- (select (s, count/d) from (s, d) <- edges group by s) where d == i && k == s && q == s))) from i <- nodes limit 3", "id r", _pagerank_sql(3, "SELECT s AS id FROM e UNION SELECT d FROM e"), 10, bind={"edges": lambda t: _graph(t)})

program("pagerank", "var out: vector[Long] = vector(); var rank: vector[Double] = vector(); var flow: vector[Double] = vector(); for e in Edge do out[e.s] += 1L; for v in Node do rank[v] := 1.0 / n; var round: Int = 0; while (round < 3) { for v in Node do flow[v] := 0.0; for e in Edge do flow[e.d] += rank[e.s] / out[e.s]; for v in Node do rank[v] := 0.15 / n + 0.85 * flow[v]; round += 1; };", "rank", _pagerank_sql(3, "SELECT s AS id FROM e UNION SELECT d FROM e").replace("SELECT id, round(r, 10) AS r FROM", "SELECT id AS i, round(r, 10) AS v FROM"), lambda t: {"Edge": _graph(t), "Node": _nodes(t), "n": _nodes(t).count()}, places=10)

query("nested_group_in_head", "select (c.c_custkey, select <s = s, n = count/o> from o <- orders where o.o_custkey == c.c_custkey group by s: o.o_orderstatus order by s) from c <- customer", "k g", "SELECT c_custkey AS k, coalesce(g, []) AS g FROM customer LEFT JOIN (SELECT o_custkey, list({'s': s, 'n': n} ORDER BY s) AS g FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) ON o_custkey = c_custkey", None)
query("join_behind_unnest", "select (l.label, e.vec_id, c.c_name) from e <- embeddings, i <- List(0, 1, 2), l <- (select <label = x.label, id = x.vec_id> from x <- embeddings), c <- customer where e.vec_id == l.id && l.id + i == c.c_custkey", "l k n", "SELECT label AS l, vec_id AS k, c_name AS n FROM embeddings, (VALUES (0), (1), (2)) t(i), customer WHERE vec_id + i = c_custkey")
PRODUCT = f"WITH m AS {MATRIX} SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2"
query("matmul_join_group", "select (i, k, +/z) from (i, j, x) <- M, (k, j2, y) <- N, z = x * y where j == j2 group by (i, k)", "i j v", PRODUCT, 2, bind={"M": lambda t: _matrix(t), "N": lambda t: _matrix(t)})
program("matrix_mult", "var R: matrix[Double] = matrix(); for i = 0, n do for j = 0, n do { R[i,j] := 0.0; for k = 0, 39 do R[i,j] += M[i,k] * N[k,j]; };", "R", f"WITH m AS {MATRIX}, t AS (SELECT max(i) + 1 AS n FROM m), g AS (SELECT a.i, b.j FROM (SELECT unnest(range(0, n)) AS i FROM t) a, (SELECT unnest(range(0, n)) AS j FROM t) b), x AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2) SELECT g.i AS i, g.j AS j, round(coalesce(x.v, 0), 2) AS v FROM g LEFT JOIN x ON x.i = g.i AND x.j = g.j", lambda t: {"M": _matrix(t), "N": _matrix(t).select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), "n": _top(t["lineitem"], "l_suppkey")}, places=2)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.operators.bags import multiply_grid

    m = _matrix(Lazy(spark, sf_dir))
    return rounded(multiply_grid(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), 4, 4), 2)


QUERIES["matmul_grid"], ORACLE_SQL["matmul_grid"] = _grid, PRODUCT
program("defaults", "var R: vector[Double] = vector(); for i = 0, n do R[i] := (V[i] : 0.0) + 1.0;", "R", "SELECT i, round(coalesce(v, 0) + 1, 2) AS v FROM (SELECT unnest(range(0, max(o_orderkey) + 1)) AS i FROM orders) LEFT JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1) ON k = i", lambda t: {"V": t["lineitem"].groupBy(F.col("l_orderkey").alias("i")).agg(F.sum("l_quantity").alias("v")), "n": _top(t["orders"], "o_orderkey")}, twin=False, places=2)


def _components(t: Lazy) -> DataFrame:
    return t["embeddings"].select("vec_id", F.posexplode("embedding").alias("j", "x")).select(F.col("vec_id").alias("i"), F.col("j").cast("long"), F.col("x").cast("double").alias("v"))


program("pca_cov", "var mean: vector[Double] = vector(); var cov: matrix[Double] = matrix(); for i = 0, d do for r = 0, n - 1 do mean[i] += P[r,i]; for i = 0, d do mean[i] := mean[i] / n; for i = 0, d do for j = 0, d do for r = 0, n - 1 do cov[i,j] += (P[r,i] - mean[i]) * (P[r,j] - mean[j]); for i = 0, d do for j = 0, d do cov[i,j] := cov[i,j] / (n - 1);", "cov", "WITH p AS (SELECT vec_id AS r, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 5) AS v FROM p a JOIN p b ON a.r = b.r GROUP BY 1, 2", lambda t: {"P": _components(t), "n": t["embeddings"].count(), "d": t["embeddings"].agg(F.max(F.size("embedding"))).first()[0] - 1}, places=5)
STARTS = ((0, 5.0, 5.0), (1, 40.0, 10.0), (2, 10.0, 40.0), (3, 45.0, 45.0))


def _kmeans_loop_sql(k: int) -> str:
    ctes = ["p AS (SELECT l_quantity AS x, l_discount * 500 AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)", f"c0 AS (SELECT j, x::DOUBLE AS x, y::DOUBLE AS y FROM (VALUES {', '.join(map(str, STARTS))}) t(j, x, y))"]
    for i in range(1, k + 1):
        ctes.append(f"d{i} AS (SELECT p.x, p.y, p.n, arg_min(c.j, ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.j)) AS j FROM p, c{i - 1} c GROUP BY ALL)")
        ctes.append(f"c{i} AS (SELECT j, sum(x * n) / sum(n) AS x, sum(y * n) / sum(n) AS y FROM d{i} GROUP BY j)")
    return f"WITH {', '.join(ctes)} SELECT j::BIGINT AS i, round(x, 5) AS x, round(y, 5) AS y FROM c{k}"


def _points(t: Lazy) -> dict[str, Any]:
    from bagloom.sources.scans import vector

    points = vector(t["lineitem"].select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y")), ["x", "y"])
    starts = t.spark.createDataFrame([(i, (x, y)) for i, x, y in STARTS], "i long, v struct<_1: double, _2: double>")
    return {"P": points, "n": t["lineitem"].count(), "S": starts}


program("kmeans", "var C: vector[(Double, Double)] = vector(); var D: matrix[Double] = matrix(); var closer: matrix[Long] = matrix(); var sx: vector[Double] = vector(); var sy: vector[Double] = vector(); var m: vector[Double] = vector(); for j = 0, 3 do C[j] := S[j]; var k: Int = 0; while (k < 3) { k += 1; for i = 0, n - 1 do for j = 0, 3 do D[i,j] := (P[i].x - C[j]._1) * (P[i].x - C[j]._1) + (P[i].y - C[j]._2) * (P[i].y - C[j]._2); for i = 0, n - 1 do for j = 0, 3 do closer[i,j] := 0L; for i = 0, n - 1 do for j = 0, 3 do for l = 0, 3 do if (D[i,l] < D[i,j] || (D[i,l] == D[i,j] && l < j)) closer[i,j] += 1L; for j = 0, 3 do { sx[j] := 0.0; sy[j] := 0.0; m[j] := 0.0; }; for i = 0, n - 1 do for j = 0, 3 do if (closer[i,j] == 0L) { sx[j] += P[i].x; sy[j] += P[i].y; m[j] += 1.0; }; for j = 0, 3 do C[j] := (sx[j] / m[j], sy[j] / m[j]); };", "C", _kmeans_loop_sql(3), _points)
for _name in ("loop_kmeans", "sql_kmeans"):
    QUERIES[_name] = lambda spark, sf_dir, run=QUERIES[_name]: run(spark, sf_dir).select("i", F.round(F.col("v").getField("_1"), 5).alias("x"), F.round(F.col("v").getField("_2"), 5).alias("y"))


def _factors_sql(steps: int) -> str:
    """Gradient descent on the squared error of U W' with a penalty; both factors move together."""
    ctes = ["x AS (SELECT l_suppkey % 6 AS i, l_partkey % 5 AS j, avg(l_quantity) / 50 AS v FROM lineitem GROUP BY 1, 2)", "u0 AS (SELECT i, k, (i + k + 1) / 10.0::DOUBLE AS v FROM range(0, 6) a(i), range(0, 2) b(k))", "w0 AS (SELECT j, k, (k + 2 * j + 1) / 10.0::DOUBLE AS v FROM range(0, 5) a(j), range(0, 2) b(k))"]
    for t in range(steps):
        ctes.append(f"g{t} AS (SELECT x.i, x.j, x.v - sum(u.v * w.v) AS v FROM x JOIN u{t} u ON u.i = x.i JOIN w{t} w ON w.j = x.j AND w.k = u.k GROUP BY x.i, x.j, x.v)")
        ctes.append(f"u{t + 1} AS (SELECT u.i, u.k, u.v + 0.01 * (2 * sum(g.v * w.v) - 0.02 * u.v) AS v FROM u{t} u JOIN g{t} g ON g.i = u.i JOIN w{t} w ON w.j = g.j AND w.k = u.k GROUP BY u.i, u.k, u.v)")
        ctes.append(f"w{t + 1} AS (SELECT w.j, w.k, w.v + 0.01 * (2 * sum(g.v * u.v) - 0.02 * w.v) AS v FROM w{t} w JOIN g{t} g ON g.j = w.j JOIN u{t} u ON u.i = g.i AND u.k = w.k GROUP BY w.j, w.k, w.v)")
    return f"WITH {', '.join(ctes)} SELECT j AS i, k AS j, round(v, 6) AS v FROM w{steps}"


program("matrix_factorization", "var U: matrix[Double] = matrix(); var W: matrix[Double] = matrix(); var gap: matrix[Double] = matrix(); var down: matrix[Double] = matrix(); var across: matrix[Double] = matrix(); for k = 0, 1 do { for i = 0, 5 do U[i,k] := (i + k + 1) / 10.0; for j = 0, 4 do W[j,k] := (k + 2 * j + 1) / 10.0; }; var t: Int = 0; while (t < 4) { for i = 0, 5 do for j = 0, 4 do gap[i,j] := X[i,j]; for i = 0, 5 do for j = 0, 4 do for k = 0, 1 do gap[i,j] += 0.0 - U[i,k] * W[j,k]; for i = 0, 5 do for k = 0, 1 do down[i,k] := 0.0 - 0.02 * U[i,k]; for j = 0, 4 do for k = 0, 1 do across[j,k] := 0.0 - 0.02 * W[j,k]; for i = 0, 5 do for j = 0, 4 do for k = 0, 1 do { down[i,k] += 2.0 * gap[i,j] * W[j,k]; across[j,k] += 2.0 * gap[i,j] * U[i,k]; }; for i = 0, 5 do for k = 0, 1 do U[i,k] += 0.01 * down[i,k]; for j = 0, 4 do for k = 0, 1 do W[j,k] += 0.01 * across[j,k]; t += 1; };", "W", _factors_sql(4), lambda t: {"X": t["lineitem"].groupBy((F.col("l_suppkey") % 6).alias("i"), (F.col("l_partkey") % 5).alias("j")).agg((F.avg("l_quantity") / 50).alias("v"))}, places=6)


# ---- bags of one column, states of several bags, scans and strings inside queries ----


def _one(t: Lazy) -> DataFrame:
    return t["lineitem"].select("l_quantity")


query("one_column_total", "(+/Q, max/(select x + .5 from x <- Q where x > 10.0), count/Q)", "s m n", "SELECT round(sum(l_quantity), 4) AS s, max(l_quantity) + 0.5 AS m, count(*) AS n FROM lineitem", bind={"Q": lambda t: _one(t)})
query("one_column_group", "select (k, +/x, count/x) from x <- Q group by k: x % 7.0", "k s n", "SELECT l_quantity % 7 AS k, round(sum(l_quantity), 4) AS s, count(*) AS n FROM lineitem GROUP BY 1", bind={"Q": lambda t: _one(t)})
query("broadcast_cross", "select (s.s_suppkey, r.r_name) from s <- supplier, r <-- region", "k r", "SELECT s_suppkey AS k, r_name AS r FROM supplier, region")
query("broadcast_theta", "select (c.c_custkey, n.n_name) from c <- customer, n <-- nation where c.c_nationkey < n.n_nationkey && n.n_regionkey == 3", "k n", "SELECT c_custkey AS k, n_name AS n FROM customer, nation WHERE c_nationkey < n_nationkey AND n_regionkey = 3")
query("cons_cells", "select (n.n_nationkey, +/(n.n_nationkey::List(n.n_regionkey, 100))) from n <- nation", "k s", "SELECT n_nationkey AS k, n_nationkey + n_regionkey + 100 AS s FROM nation")
query("symbol_operator", "select (s, <+>/p) from o <- orders, p = o.o_totalprice group by s: o.o_orderstatus", "s m", "SELECT o_orderstatus AS s, round(max(o_totalprice), 4) AS m FROM orders GROUP BY 1", monoids=(lambda: ("<+>", F.greatest, None, F.max),))
query("split_words", 'select (w, count/d) from d <- documents, w <- d.text.split(" ") group by w: w', "w n", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")


def _scan_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.api import Session

    return rounded(Session().q("select (k, +/o.o_totalprice) from o <- parquet(path) group by k: o.o_orderpriority", spark=spark, path=f"{sf_dir}/orders.parquet").toDF("k", "s"), 2)


QUERIES["scan_in_query"], ORACLE_SQL["scan_in_query"] = _scan_call, "SELECT o_orderpriority AS k, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1"


def _two_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs and authorities without scaling: nations and segments weigh each other over customers, both bags being the state."""
    from bagloom.api import Session

    text = """repeat (a, b) = ((select (n.n_nationkey, 1) from n <- nation), (select distinct (c.c_mktsegment, 1) from c <- customer))
        step ((select (k, +/w) from c <- customer, (s, w) <- b where c.c_mktsegment == s group by k: c.c_nationkey),
              (select (k, max/w) from c <- customer, (n, w) <- a where c.c_nationkey == n group by k: c.c_mktsegment)) limit 2"""
    a, b = Session().q(text, spark=spark, **Lazy(spark, sf_dir).named(text))
    return a.select(F.col("_1").cast("string").alias("k"), F.col("_2").cast("long").alias("w")).unionByName(b.select(F.col("_1").alias("k"), F.col("_2").cast("long").alias("w")))


QUERIES["repeat_two_bags"], ORACLE_SQL["repeat_two_bags"] = _two_bags, """WITH a1 AS (SELECT c_nationkey AS n, count(*) AS w FROM customer GROUP BY 1),
    b1 AS (SELECT DISTINCT c_mktsegment AS s, 1 AS w FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)),
    a2 AS (SELECT c_nationkey AS n, sum(b1.w) AS w FROM customer JOIN b1 ON s = c_mktsegment GROUP BY 1),
    b2 AS (SELECT c_mktsegment AS s, max(a1.w) AS w FROM customer JOIN a1 ON n = c_nationkey GROUP BY 1)
    SELECT n::VARCHAR AS k, w::BIGINT AS w FROM a2 UNION ALL SELECT s, w::BIGINT FROM b2"""


def _small_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bagloom.operators.bags import cogroup_small

    t = Lazy(spark, sf_dir)
    nation = t["nation"].select(F.col("n_nationkey").alias("k"), "n_name")
    return cogroup_small(t["customer"].select(F.col("c_nationkey").alias("k"), "c_acctbal"), nation, ["k"], [F.count("k").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("s")])


QUERIES["cogroup_small"], ORACLE_SQL["cogroup_small"] = _small_cogroup, "SELECT n_nationkey AS k, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"
