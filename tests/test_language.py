"""Query texts against values worked out by hand or by plain Python, on a small workshop."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bagloom.api import Session, debug, debug_all, explain
from bagloom.lang.parsing import parse_query
from bagloom.lang.tree import Bin, QueryError, Reduce, Un, free

PARTS = [("bolt", 4, [7, 2]), ("gear", 1, [9]), ("hose", 0, []), ("lamp", 6, [3, 3, 8]), ("nail", 4, [5, 1]), ("pump", 2, [6, 9])]
SHELVES = [(0, "attic"), (1, "bench"), (2, "cellar"), (4, "yard")]
SALES = [(1, "ann", 12.5), (2, "bob", 3.0), (2, "ann", 3.0), (3, None, 8.0), (4, "bob", 20.0), (4, "bob", 20.0)]


@pytest.fixture(scope="module")
def run(spark):
    session = Session()
    bound = {
        "Part": spark.createDataFrame(PARTS, "label string, shelf long, sizes array<long>"),
        "Shelf": spark.createDataFrame(SHELVES, "nr long, place string"),
        "Sale": spark.createDataFrame(SALES, "day long, who string, paid double"),
        "Nothing": spark.createDataFrame([], "day long, paid double"),
        "marks": [6, 10, 15],
    }
    session.m("def onShelf(nr: Int) = select p.label from p <- Part where p.shelf == nr; def squares(xs: Bag) = select a * a from a <- xs")
    session.monoid("gcdlike", F.greatest, 0, F.max)
    session.monoid("concatLen", lambda a, b: a + b, 0)
    session.monoid("<>", F.least, None, F.min)

    def go(text, **more):
        rows = session.q(text, spark=spark, **bound, **more).collect()
        return [plain(r) for r in rows]

    return go


def plain(x):
    if isinstance(x, Row):
        t = tuple(plain(y) for y in x)
        return t[0] if list(x.asDict()) == ["value"] else t
    return [plain(y) for y in x] if isinstance(x, list) else x


CASES = [
    # values
    ("11::List(0, 7)", [[11, 0, 7]]),
    ("max/List(4, 19, 2)", [19]),
    ("concatLen/marks", [31]),
    ("<>/List(0.5, 0.25)", [0.25]),
    ("marks.map(_ * 10)", [[60, 100, 150]]),
    ("marks.map(m => m - 6).reduce(Math.max)", [9]),
    ("(-9 / 4, 9 / 4, 9.0 / 4, 11 % 4, 5 / 0)", [(-2, 2, 2.25, 3, None)]),
    ("(+/(select paid from (_, paid) <- Nothing), count/Nothing, min/(select paid from (_, paid) <- Nothing))", [(0.0, 0, None)]),
    # patterns and filters
    ("select p.label from p <- Part where p.shelf > 2", ["bolt", "lamp", "nail"]),
    ("select (label, a) from (label, 4, a::_) <- Part", [("bolt", 7), ("nail", 5)]),
    ("select (label, kept) from (label, _, kept@List(9)) <- Part", [("gear", [9])]),
    ("select (label, more) from (label, _, List(3, more@_*)) <- Part", [("lamp", [3, 8])]),
    ("select (label, s * 2) from (label, _, sizes) <- Part, s <- sizes where s > 7", [("gear", 18), ("lamp", 16), ("pump", 18)]),
    ("select label + \"#\" + shelf from (label, shelf, _) <- Part where shelf == 6", ["lamp#6"]),
    ("select (m, m match { case 6 => \"half\" case k by k > 12 => \"over\" case _ => \"full\" }) from m <- marks", [(6, "half"), (10, "full"), (15, "over")]),
    ("select distinct (day, paid) from (day, _, paid) <- Sale", [(1, 12.5), (2, 3.0), (3, 8.0), (4, 20.0)]),
    # reductions over nested values
    ("select (label, count/sizes, +/sizes) from (label, _, sizes) <- Part", [(a, len(z), sum(z)) for a, _, z in PARTS]),
    ("select label from (label, shelf, sizes) <- Part where shelf < count/sizes", [a for a, n, z in PARTS if n < len(z)]),
    ("avg/(select d from d <- (1 to 9).toList where d % 4 == 1)", [5.0]),
    # joins
    ("select (p.label, s.place) from p <- Part, s <- Shelf where s.nr == p.shelf", [(a, w) for a, n, _ in PARTS for k, w in SHELVES if k == n]),
    ("select (nr, m) from (nr, _) <- Shelf, m <- marks where nr + 5 == m - 1 || nr * 5 == m", [(n, m) for n, _ in SHELVES for m in (6, 10, 15) if n + 5 == m - 1 or n * 5 == m]),
    ("select (a.label, b.label, w) from a <- Part, b <- Part, (k, w) <- Shelf where a.shelf == b.shelf && k == a.shelf && a.label < b.label", [("bolt", "nail", "yard")]),
    ("select label from (label, shelf, sizes) <- Part where (some z <- sizes: z == 9)", ["gear", "pump"]),
    ("some (_, who, paid) <- Sale: paid > 19.5", [True]),
    ("all (day, _, _) <- Sale: day < 4", [False]),
    ("all (_, paid) <- Nothing: paid > 1000.0", [True]),
    ("select place from (nr, place) <- Shelf where !(some p <- Part: p.shelf == nr)", []),
    ("select label from (label, shelf, _) <- Part where all s <- (select s from s <- Shelf where s.nr == shelf): s.place == \"yard\"", ["bolt", "nail", "lamp"]),
    ("select place from (nr, place) <- Shelf where nr member (select day from (day, _, _) <- Sale)", ["bench", "cellar", "yard"]),
    # nested queries
    ("select (place, +/(select paid from (day, _, paid) <- Sale where day == nr)) from (nr, place) <- Shelf", [("attic", 0.0), ("bench", 12.5), ("cellar", 6.0), ("yard", 40.0)]),
    ("select (place, (select label from (label, shelf, _) <- Part where shelf < nr).sorted) from (nr, place) <- Shelf where nr < 4", [("attic", []), ("bench", ["hose"]), ("cellar", ["gear", "hose"])]),
    ("select place from (nr, place) <- Shelf where 5.0 < +/(select paid from (day, _, paid) <- Sale where day == nr)", ["bench", "cellar", "yard"]),
    ("select (label, (select place from (nr, place) <- Shelf order by abs(nr - shelf)).head) from (label, shelf, _) <- Part where shelf > 4 || shelf == 1", [("gear", "bench"), ("lamp", "yard")]),
    ("select (place, select (who, count/(select d from (d, _, _) <- Sale where d < day)) from (day, who, _) <- Sale where day == nr) from (nr, place) <- Shelf where nr == 1", [("bench", [("ann", 0)])]),
    # groups
    ("select (who, +/paid) from (_, who, paid) <- Sale group by who", [("ann", 15.5), ("bob", 43.0), (None, 8.0)]),
    ("select (who, max/day) from (day, who, paid) <- Sale group by who having count/paid < 3", [("ann", 2), (None, 3)]),
    ("select (odd, big, count/day) from (day, _, paid) <- Sale group by (odd, big): (day % 2, paid > 10.0)", [(0, False, 2), (0, True, 2), (1, False, 1), (1, True, 1)]),
    ("select (w, count/paid, count/label) from (day, _, paid) <- Sale group by w: day from (label, shelf, _) <- Part group by shelf", [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 1, 0), (4, 2, 2), (6, 0, 1)]),
    # bags
    ("(select shelf from (_, shelf, _) <- Part) intersect (select nr from (nr, _) <- Shelf where nr > 1)", [2, 4, 4]),
    ("(select who from (_, who, _) <- Sale) minus List(\"ann\")", ["bob", "bob", "bob", None]),
    ("(select nr from (nr, _) <- Shelf) union (select day from (day, _) <- Nothing)", [0, 1, 2, 4]),
    ("let low = (select nr from (nr, _) <- Shelf where nr < 2) in low ++ low", [0, 0, 1, 1]),
    # loops and macros; `until` looks at the state before the step
    ("repeat xs = marks step xs.map(_ - 2) until (+/xs) < 20", [0, 4, 9]),
    ("repeat n = 3 step n * n until n > 50", [6561]),
    ("repeat days = (select day from (day, _, _) <- Sale) step select d * 2 from d <- days limit 3", [8, 16, 16, 24, 32, 32]),
    ("select l from l <- onShelf(4)", ["bolt", "nail"]),
    ("select q from q <- marks.squares()", [36, 100, 225]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_query(run, text, want):
    got = run(text)
    if want is not None:
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_order_is_kept(run):
    assert run("select label from (label, _, sizes) <- Part order by (count/sizes desc, label)") == [a for a, _, z in sorted(PARTS, key=lambda p: (-len(p[2]), p[0]))]
    assert run("(select nr from (nr, _) <- Shelf order by nr desc).take(2)") == [4, 2]


def test_precedence_and_names():
    assert parse_query("!p || q") == Bin("||", Un("!", parse_query("p")), parse_query("q"))
    assert parse_query("max/u * min/w") == Bin("*", Reduce("max", parse_query("u")), Reduce("min", parse_query("w")))
    assert parse_query("a + b < c && d") == Bin("&&", Bin("<", Bin("+", parse_query("a"), parse_query("b")), parse_query("c")), parse_query("d"))
    assert free(parse_query("select (p, q, out) from p <- Shop, q <- p.items where q > least")) == {"Shop", "out", "least"}


@pytest.mark.parametrize("text", ["select x from", "select p from p <- Part where", "repeat n = 1 step n", "(1, 2", "select p from p <- Part group k", "x $ §"])
def test_syntax_errors(text):
    with pytest.raises(QueryError):
        parse_query(text)


@pytest.mark.parametrize("text", ["select a from (a, b, c, d) <- Part", "select missing from (label, n, z) <- Part", "nothing(3)", "select x from x <- Unknown", "zzz/marks"])
def test_meaning_errors(run, text):
    with pytest.raises(QueryError):
        run(text)


def test_lineage(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    d = spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "id long, x long")
    rows = debug("select (k, +/x) from n <- N, (i, x) <- D where n.id == i group by k: n.id", spark=spark, N=n, D=d).collect()
    assert {r[0]: sorted(x["source"] for x in r["lineage"]) for r in rows} == {1: ["D", "D", "N"], 3: ["D", "N"]}
    status = {(r["source"], r["row"]): r["status"] for r in debug_all("select (n.name, x) from n <- N, (i, x) <- D where n.id == i", spark=spark, N=n, D=d).collect()}
    assert status["N", '{"id":2,"name":"b"}'] == "erased" and list(status.values()).count("kept") == 5


def test_explain(spark):
    text = str(explain("select (k, +/a) from (k, a) <- D group by k", spark=spark, D=spark.createDataFrame([(1, 2.0)], "k long, a double")))
    assert "Select(" in text and "HashAggregate" in text
