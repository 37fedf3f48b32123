"""Random small bags: queries beside plain Python comprehensions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Row

from bagloom.api import Session


def plain(x):
    if isinstance(x, Row):
        t = tuple(plain(y) for y in x)
        return t[0] if list(x.asDict()) == ["value"] else t
    return [plain(y) for y in x] if isinstance(x, list) else x


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


QUERIES = {
    "select (a, b, c) from (a, b) <- X, (b2, c) <- Y where b == b2 && a < c": lambda X, Y: [(a, b, c) for a, b in X for b2, c in Y if b == b2 and a < c],
    "select (a, count/b, +/b, max/b) from (a, b) <- X group by a": lambda X, Y: [(a, len(g), sum(b for _, b in g), max(b for _, b in g)) for a, g in groups(X, lambda r: r[0]).items()],
    "select (a, b, +/(select c from (k, c) <- Y where k == a)) from (a, b) <- X": lambda X, Y: [(a, b, sum(c for k, c in Y if k == a)) for a, b in X],
    "select (a, b, count/(select c from (k, c) <- Y where k < a && c > b)) from (a, b) <- X": lambda X, Y: [(a, b, sum(k < a and c > b for k, c in Y)) for a, b in X],
    "select (a, b) from (a, b) <- X where some (k, c) <- Y: k == b && c != a": lambda X, Y: [(a, b) for a, b in X if any(k == b and c != a for k, c in Y)],
    "select (a, b) from (a, b) <- X where all (k, c) <- (select y from y@(k, c) <- Y where k == a): c >= b": lambda X, Y: [(a, b) for a, b in X if all(c >= b for k, c in Y if k == a)],
    "select (a, (select (c, count/k) from (k, c) <- Y where k == a group by c).sorted) from (a, b) <- X": lambda X, Y: [(a, sorted((c, len(g)) for c, g in groups([y for y in Y if y[0] == a], lambda r: r[1]).items())) for a, _ in X],
    "select distinct b from (a, b) <- X where !(b member (select k from (k, c) <- Y))": lambda X, Y: list({b for _, b in X if b not in [k for k, _ in Y]}),
    "(select a from (a, b) <- X) minus (select c from (k, c) <- Y)": lambda X, Y: [a for a, _ in X if a not in {c for _, c in Y}],
    "(select a from (a, b) <- X) intersect (select c from (k, c) <- Y)": lambda X, Y: [a for a, _ in X if a in {c for _, c in Y}],
    "select (k, count/a, count/c) from (k, a) <- X group by k from (k2, c) <- Y group by k2": lambda X, Y: [(k, sum(a == k for a, _ in X), sum(b == k for b, _ in Y)) for k in {a for a, _ in X} | {b for b, _ in Y}],
    "select (a, +/(select count/(select z from (z, w) <- Y where z == k && w > a) from (k, c) <- Y where k == b)) from (a, b) <- X": lambda X, Y: [(a, sum(sum(z == k and w > a for z, w in Y) for k, c in Y if k == b)) for a, b in X],
    "select (a, b, (select c from (k, c) <- Y where k == a order by c).head) from (a, b) <- X": lambda X, Y: [(a, b, min((c for k, c in Y if k == a), default=None)) for a, b in X],
    "select (x, +/(select y * 2 from y <- xs where y > x)) from (x, xs) <- (select (a, [b, a, 3]) from (a, b) <- X)": lambda X, Y: [(a, sum(y * 2 for y in [b, a, 3] if y > a)) for a, b in X],
}


@pytest.mark.parametrize("text", QUERIES)
@pytest.mark.parametrize("seed", [0, 1])
def test_like_python(spark, text, seed):
    r = random.Random(seed)
    x, y = ([(r.randrange(6), r.randrange(6)) for _ in range(r.choice([0, 3, 12]) if seed else 12)] for _ in range(2))
    bound = {"X": spark.createDataFrame(x, "a long, b long"), "Y": spark.createDataFrame(y, "k long, c long")}
    got = [plain(t) for t in Session().q(text, spark=spark, **bound).collect()]
    assert sorted(got, key=repr) == sorted(QUERIES[text](x, y), key=repr)
