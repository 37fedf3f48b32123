import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from bagloom.llm import katz


def brute(docs, order):
    """docs: (id, text, learn). Katz scores by dictionaries."""
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t, _ in docs]
    grams = {n: Counter() for n in range(1, order + 1)}
    for (_, _, learn), ws in zip(docs, toks):
        line = ["<s>", *ws]
        for n in grams if learn else ():
            grams[n].update(tuple(line[i : i + n]) for i in range(n == 1, len(line) - n + 1))
    uni = {w: c for (w,), c in grams[1].items()}
    total = sum(uni.values())
    kinds = {n: [sum(c == r for c in g.values()) for r in range(1, katz.K + 2)] for n, g in grams.items()}
    u, d = katz.Unigrams(total, kinds[1]), {n: katz.Discounts(k) for n, k in kinds.items()}
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            after[g[:-1]].append((g[-1], c))
    dd = lambda n, c: float(d[n].of(np.array([c]))[0])

    @lru_cache(None)
    def p(h, w):
        if not h:
            return float(u.of(np.array([uni.get(w, 0)]))[0])
        n, seen = len(h) + 1, after[h]
        if not seen:
            return p(h[1:], w)
        size = sum(c for _, c in seen)
        size += sum((1 - dd(n, c)) * c for _, c in seen) <= 1e-9
        if grams[n][(*h, w)]:
            return dd(n, grams[n][(*h, w)]) * grams[n][(*h, w)] / size
        left = 1 - sum(dd(n, c) * c / size for _, c in seen)
        return left / (1 - sum(p(h[1:], x) for x, _ in seen)) * p(h[1:], w)

    # every distribution adds up to 1
    for h in [*list(after)[:20], *list(after)[-20:], ("never",)]:
        assert math.isclose(sum(p(h, w) for w in uni) + p(h, "\0new"), 1, rel_tol=1e-9)
    out = []
    for (i, _, learn), ws in zip(docs, toks):
        line = ["<s>", *ws]
        s = sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in ws)
        out.append((i, not learn, len(ws), sum(w in uni for w in ws), total, round(base, 6), round(s, 6)))
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(vocab[min(59, int(r.expovariate(0.12)))] for _ in range(r.randint(0, 60))), zlib.crc32(str(i).encode()) % 5 != 1) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("docs", [
    made(1, 80),
    [(0, None, True), (1, "", True), (2, "A a\ta a b", True), (2, "A a\ta a b", True), (3, "a zz", False), (None, "b", True)],
    [(0, "a b", False)],
    [(i, "the " * 500 + f"x{i}", True) for i in range(40)] + [(99, "the x1 the y", False)],
])
def test_against_dictionaries(spark, docs, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 700)
    df = spark.createDataFrame(docs, "doc_id long, text string, learn boolean").repartition(3)
    got = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in katz.score(df, order).collect()]
    assert sorted(got, key=repr) == brute(docs, order)


def test_empty_table_and_extra_columns(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string, learn boolean, chunk int")).count() == 0
    df = spark.createDataFrame([(1, "a b", True, 7, "q")], "doc_id long, text string, learn boolean, chunk int, shard string")
    assert katz.score(df).first()["n_tokens"] == 3
