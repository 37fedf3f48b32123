"""Fluent operators, sources, sinks and streams."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bagloom.api import Session, stream
from bagloom.operators import bags
from bagloom.operators.lineage import search_input, search_output, why
from bagloom.sources import scans, sinks
from bagloom.sources.staging import shared_dir
from bagloom.streaming.incremental import analyse, drained


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bag_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (None,), (5,)], "k int")
    assert rows(bags.union(a, b)) == [(1,)] * 3 + [(2,), (5,), (None,), (None,)]
    assert rows(bags.intersect(a, b)) == [(1,), (1,), (None,)]
    assert rows(bags.minus(a, b)) == [(2,)]


def test_grouping_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0)], "k int, x double")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string")
    assert rows(bags.cogroup(a, b, ["k"], [F.sum("x").alias("s")], [F.max("y").alias("m")])) == [(1, 3.0, "p"), (2, None, "q"), (None, 3.0, None)]
    assert [(r[0], len(r["bag"])) for r in bags.nest_join(b, a, [("k", "k")], "bag").orderBy("k").collect()] == [(1, 2), (2, 0)]
    assert rows(bags.cogroup_small(a, b, ["k"], [F.count("x").alias("n")])) == [(1, 2, "p")]
    assert rows(bags.join(a, b, [("k", "k")], True).select("x", "y")) == [(1.0, "p"), (2.0, "p")]


def test_products(spark):
    a = spark.createDataFrame([(i, j, float(i + 2 * j)) for i in range(6) for j in range(5) if (i + j) % 3], "i long, j long, v double")
    want = {}
    m = {(r[0], r[1]): r[2] for r in a.collect()}
    for (i, k), x in m.items():
        for (k2, j), y in m.items():
            if k == k2:
                want[i, j] = want.get((i, j), 0) + x * y
    for df in (bags.multiply(a, a), bags.multiply_grid(a, a, 2, 3)):
        assert {(r["i"], r["j"]): r["v"] for r in df.collect()} == want


def test_merge_and_repeat(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i long, v double")
    new = spark.createDataFrame([(2, 5.0), (3, 7.0)], "i long, v double")
    assert rows(bags.merge(old, new, ["i"])) == [(1, 1.0), (2, 5.0), (3, 7.0)]
    assert rows(bags.merge(old, new, ["i"], lambda a, b: a + b)) == [(1, 1.0), (2, 7.0), (3, 7.0)]
    out = bags.repeat(old, lambda d: d.withColumn("v", F.col("v") * 2), until=lambda d: d.agg(F.sum("v")).first()[0] > 10)
    assert rows(out) == [(1, 8.0), (2, 16.0)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "g.txt").write_text("3,2,1\n2,4\n7\n")
    assert rows(scans.adjacency(spark, str(tmp_path / "g.txt"))) == [(2, [4]), (3, [2, 1]), (7, [])]
    (tmp_path / "p.csv").write_text("1.5,2\n,3\n")
    assert rows(scans.fields(spark, str(tmp_path / "p.csv"), "x double, y int")) == [(1.5, 2), (None, 3)]
    assert scans.whole_files(spark, str(tmp_path / "g.txt")).first()["content"].startswith("3,2,1\n")
    assert rows(scans.inclusive_range(spark, 1, 7, 3)) == [(1,), (4,), (7,)]
    v = scans.vector(scans.bag(spark, ["b", "a", "c"]), ["value"])
    assert rows(v) == [(0, "a"), (1, "b"), (2, "c")]
    assert scans.empty_array(spark, "matrix", "double").columns == ["i", "j", "v"]
    sinks.save_text(v, str(tmp_path / "out"))
    assert rows(scans.lines(spark, str(tmp_path / "out"))) == [("0,a",), ("1,b",), ("2,c",)]
    sinks.save(v, str(tmp_path / "orc"), "orc")
    assert rows(spark.read.orc(str(tmp_path / "orc"))) == rows(v)
    assert sinks.element(v.filter("i = 1"))["v"] == "b" and sinks.element(v.filter("i > 5")) is None
    with pytest.raises(ValueError):
        sinks.collect(v, 2)


def test_lineage_search(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    from bagloom.api import debug

    traced = debug("select <name = n.name> from n <- N", spark=spark, N=n)
    assert rows(why(traced, "name = 'a'").select("row")) == [('{"id":1,"name":"a"}',)]
    assert [r["name"] for r in search_input(traced, "N", '"id":2').collect()] == ["b"]
    assert [r["name"] for r in search_output(traced, '"a"').collect()] == ["a"]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k long, x double").repartition(3).write.parquet(str(tmp_path / "t"))
    live = spark.readStream.schema("k long, x double").parquet(str(tmp_path / "t"))
    text = "select (g, +/s.x, count/s, max/s.x) from s <- S where s.x > 2.0 group by g: s.k having count/s > 1"
    batch = rows(Session().q(text, spark=spark, S=spark.read.parquet(str(tmp_path / "t"))))
    assert rows(drained(text, {"S": live, "spark": spark})) == batch
    assert rows(drained("select s.x from s <- S where s.k == 1", {"S": live, "spark": spark})) == [(float(i),) for i in sorted(range(1, 30, 3), key=lambda i: repr((float(i),)))]
    assert rows(drained("+/(select s.x from s <- S)", {"S": live, "spark": spark})) == [(435.0,)]
    for bad in ("select s from s <- S order by s.x", "select distinct s.k from s <- S", "select (k, s) from s <- S group by k: s.k", "select (a, b) from a <- S, b <- S where a.k == b.k", "select (k, mine/s.x) from s <- S group by k: s.k"):
        session = Session()
        session.monoid("mine", lambda a, b: a + b, 0.0)
        with pytest.raises(ValueError):
            drained(bad, {"S": live, "spark": spark}, session)
    from bagloom.lang.parsing import parse_query

    found = analyse(parse_query(text), {"S"}, {})
    assert found.incremental and found.mode == "update" and set(found.monoids) == {"+", "count", "max"}
    assert stream("select s.x from s <- S", S=live, spark=spark).isStreaming


def test_bags_of_one_column(spark, tmp_path):
    (tmp_path / "l.txt").write_text("ab c\nd\n")
    bound = {"X": spark.createDataFrame([(3,), (1,), (4,), (None,)], "i long"), "Y": spark.createDataFrame([([1, 2],), ([],)], "xs array<long>"), "path": str(tmp_path / "l.txt")}
    go = lambda text: rows(Session().q(text, spark=spark, **bound))
    assert go("+/X") == go("+/(select x.i from x <- X)") == go("+/(select x from x <- X)") == [(8,)]
    assert go("select (x + 1, x.i * .5) from x <- X where x > 1") == [(4, 1.5), (5, 2.0)]
    assert go("select (k, (select a.i * 2 from a <- x)) from x <- X where x > 0 group by k: x % 2") == [(0, [8]), (1, [6, 2])]
    assert go("select v from xs <- Y, v <- xs") == [(1,), (2,)]
    assert go("4 member X") == [(True,)] and Session().q("select x from x <- X", spark=spark, **bound).columns == ["i"]
    assert go("select l from l <- lines(path)") == [("ab c",), ("d",)] and go("count/wholeFiles(path)") == [(1,)]
    shadowed = Session()
    shadowed.function("lines", lambda c: c + 1)
    assert rows(shadowed.q("select lines(x) from x <- X where x > 3", spark=spark, **bound)) == [(5,)]


def test_state_of_two_bags(spark):
    bound = {"X": spark.createDataFrame([(4,), (5,)], "i long"), "Y": spark.createDataFrame([(1,), (4,)], "k long")}
    a, b = Session().q("repeat (a, b) = ((select x from x <- X), (select y from y <- Y)) step ((select u * 2 from u <- b), (select v + 1 from v <- a)) limit 2", spark=spark, **bound)
    assert rows(a) == [(10,), (12,)] and rows(b) == [(3,), (9,)]


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as z", "cast(id as string) as i").repartition(7, "z")
    got = scans.vector(df, ["z"], start=3).collect()
    assert sorted((r["i"], r["v"]["z"]) for r in got) == [(k + 3, k) for k in range(1000)]
    assert scans.vector(spark.range(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    jvm = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset, _jsc=jvm))
    with pytest.raises(ValueError):
        shared_dir(cluster)
