import random
import re

import numpy as np
import pytest

from bagloom.llm import count_rtree


def brute(docs, size, num, den):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    comp = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = comp[i], comp[j]
                comp = [y if c == x else c for c in comp]
    least = {}
    for c, (d, _) in zip(comp, docs):
        least[c] = min(least.get(c, 1 << 70), 1 << 70 if d is None else d)
    return sorted(((d, len(s), least[c] if least[c] < 1 << 70 else None) for c, (d, _), s in zip(comp, docs, sets)), key=repr)


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    docs = [text(r.randint(0, 80)) for _ in range(60)]
    for _ in range(8):
        base = text(r.choice([4, 9, 12, 40, 90, 300]))
        for _ in range(r.randint(2, 14)):
            own = list(base)
            for _ in range(r.randint(0, 1 + len(base) // 40)):
                own[r.randrange(len(own))] = "x" + r.choice(vocab)
            docs.append(own + text(r.randint(0, 2)))
    out = [" ".join(d) for d in docs] + ["", None, " \t", "One two", "one TWO", "a", "a", "a b c", "a  b\nc"]
    r.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)] + [(3, out[0]), (None, "only me here"), (None, out[1])]


@pytest.mark.parametrize(("seed", "size", "num", "den", "limit"), [(1, 3, 9, 10, 3_000_000), (2, 5, 4, 5, 3_000_000), (3, 3, 9, 10, 300), (4, 2, 4, 5, 100)])
def test_against_all_pairs(spark, seed, size, num, den, limit, monkeypatch):
    docs = made(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rep int").repartition(3)
    got = sorted(map(tuple, count_rtree.join(df, size, num, den, limit).collect()), key=repr)
    assert got == brute(docs, size, num, den)


def meet(sets, num, den, common):
    """Whether the larger of two sets finds the smaller one's corner."""
    a, b = sorted(sets, key=len)
    both, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    n = np.diff(bounds)
    first, upto = count_rtree.ordered(both, bounds, common, count_rtree.query_length(n, num, den))
    index = n[0] - -(-2 * num * int(n[0]) // (num + den)) + 1
    bands = np.searchsorted(count_rtree.band_edges(int(n.max()), num, den), n, "right")
    return set(first[:index].tolist()) & set(first[upto[1] :].tolist()) and bands[1] - bands[0] in (0, 1)


def test_linked_sets_meet_in_a_corner():
    r, met = np.random.default_rng(3), 0
    for trial in range(600):
        num, den = [(9, 10), (4, 5), (1, 2), (1, 3)][trial % 4]
        n = int(r.integers(1, 400))
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, int(len(base) * (1 - num / den)) + 1)))
        other = np.unique(np.concatenate([base[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, n // 12 + 1)))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        often = np.unique(r.choice(base, max(1, n // 2)))
        if len(other) and den * both >= num * (len(base) + len(other) - both):
            met += 1
            for common in ((np.zeros(0, np.uint64),) * 2, (often, r.integers(2, 9, len(often)).astype(np.uint64))):
                assert meet((base, other), num, den, common)
    assert met > 200


def test_search_finds_all_within_the_bound():
    r = np.random.default_rng(4)
    points = r.integers(0, 9, (700, 16)).astype(np.int32)
    size = points.sum(axis=1)
    tree = count_rtree.RTree(points, size)
    for q in range(0, 700, 41):
        bound = np.minimum(points, points[q]).sum(axis=1)
        want = np.flatnonzero(bound * 19 >= 9 * (size + size[q]))
        assert sorted(tree.search(points[q], int(size[q]), 9, 10)[0].tolist()) == want.tolist()


def test_empty_table(spark):
    assert count_rtree.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [3_000_000, 300])
def test_every_link_is_counted(spark, limit):
    docs = made(5)
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    count = [sum(i != j and bool(a) and 10 * len(a & b) >= 9 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string").repartition(3)
    got = count_rtree.join(df, 3, 9, 10, limit, links=True).collect()
    want = [(*row, n) for (row, n) in zip([(d, len(s)) for (d, _), s in zip(docs, sets)], count)]
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got), key=repr) == sorted(want, key=repr)
    assert max(count) > 3
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(docs, 3, 9, 10)


def test_parts_of_sets_meet_in_a_corner():
    r = np.random.default_rng(6)
    for n in range(1, 60):
        for num, den in ((1, 2), (1, 3)):
            whole = np.unique(r.integers(0, 2**63, n * den // num).astype(np.uint64))
            assert meet((np.sort(r.permutation(whole)[:n]), whole), num, den, (np.zeros(0, np.uint64),) * 2)


def test_one_row_of_each_component_with_clashing_columns(spark):
    docs = made(7)
    df = spark.createDataFrame([(d, t, i, "x", 1) for i, (d, t) in enumerate(docs)], "doc_id long, text string, ref int, __set string, leaf int").repartition(3)
    got = count_rtree.one_of_each(df, 5, 4, 5, 500)
    assert got.columns == df.columns
    rows = got.collect()
    comp = brute(docs, 5, 4, 5)
    empty = sum(n == 0 for _, n, _ in comp)
    assert sum(not (r["text"] or "").split() for r in rows) == empty
    assert len(rows) == empty + len({c for _, n, c in comp if n})
    assert {r["doc_id"] for r in rows if (r["text"] or "").split()} == {c for _, n, c in comp if n}
