"""Queries over whole tables beside plain Python: no row, id or cell is left out."""

from collections import Counter, defaultdict

import pytest

from bagloom import workloads

DATA = "/root/testdata/sf0.001"


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", ["pagerank", "loop_pagerank", "sql_pagerank"])
def test_pagerank_of_all_edges(spark, name):
    edges = set(rows(spark, "lineitem", "l_suppkey", "l_partkey"))
    ends = {x for e in edges for x in e}
    nodes = ends
    degree, rank = Counter(s for s, _ in edges), {i: 1 / len(nodes) for i in nodes}
    for _ in range(3):
        new = {i: 0.15 / len(nodes) for i in nodes}
        for s, d in edges:
            new[d] += 0.85 * rank[s] / degree[s]
        rank = new
    assert dict(map(tuple, workloads.QUERIES[name](spark, DATA).collect())) == pytest.approx(rank, abs=2e-10)


@pytest.mark.parametrize("name", ["matmul_join_group", "matmul_grid", "loop_matrix_mult", "sql_matrix_mult"])
def test_the_full_product(spark, name):
    m = defaultdict(lambda: defaultdict(float))
    for s, p, x in rows(spark, "lineitem", "l_suppkey", "l_partkey", "l_quantity"):
        m[s][p % 40] += x
    want = {(i, j): round(sum(x * b[k] for k, x in a.items() if k in b), 2) for i, a in m.items() for j, b in m.items() if a.keys() & b.keys()}
    got = {(r[0], r[1]): r[2] for r in workloads.QUERIES[name](spark, DATA).collect()}
    if "loop" in name or "sql" in name:
        top = max(m) + 1
        want = {(i, j): want.get((i, j), 0.0) for i in range(top) for j in range(top)}
    assert got == pytest.approx(want, abs=0.011)


def test_all_customers_vectors_and_cells(spark):
    got = {r[0]: [tuple(x) for x in r[1]] for r in workloads.QUERIES["nested_group_in_head"](spark, DATA).collect()}
    want = {k: Counter() for (k,) in rows(spark, "customer", "c_custkey")}
    for c, s in rows(spark, "orders", "o_custkey", "o_orderstatus"):
        want[c][s] += 1
    assert got == {k: sorted(v.items()) for k, v in want.items()}
    vectors, known = {k for (k,) in rows(spark, "embeddings", "vec_id")}, {k for (k,) in rows(spark, "customer", "c_custkey")}
    assert workloads.QUERIES["join_behind_unnest"](spark, DATA).count() == sum(v + i in known for v in vectors for i in range(3))
    cells = dict(map(tuple, workloads.QUERIES["loop_defaults"](spark, DATA).collect()))
    lines = defaultdict(float)
    for k, x in rows(spark, "lineitem", "l_orderkey", "l_quantity"):
        lines[k] += x
    assert cells == {i: lines.get(i, 0.0) + 1 for i in range(max(k for (k,) in rows(spark, "orders", "o_orderkey")) + 1)} and 1.0 in cells.values()


@pytest.mark.parametrize("name", ["loop_pca_cov", "sql_pca_cov"])
def test_covariance_of_all_components(spark, name):
    np = pytest.importorskip("numpy")
    x = np.array([v for (v,) in rows(spark, "embeddings", "embedding")], float)
    got = {(r[0], r[1]): r[2] for r in workloads.QUERIES[name](spark, DATA).collect()}
    want = np.cov(x.T)
    assert len(got) == x.shape[1] ** 2 and all(abs(want[i, j] - v) < 2e-5 for (i, j), v in got.items())


@pytest.mark.parametrize("name", ["loop_kmeans", "sql_kmeans"])
def test_points_join_their_nearest_centroid(spark, name):
    points, centroids = [(q, d * 500) for q, d in rows(spark, "lineitem", "l_quantity", "l_discount")], {i: (x, y) for i, x, y in workloads.STARTS}
    for _ in range(3):
        own = defaultdict(list)
        for x, y in points:
            own[min(centroids, key=lambda j: ((x - centroids[j][0]) ** 2 + (y - centroids[j][1]) ** 2, j))].append((x, y))
        centroids = {j: (sum(p[0] for p in own[j]) / len(own[j]), sum(p[1] for p in own[j]) / len(own[j])) for j in centroids}
    got = {r[0]: (r[1], r[2]) for r in workloads.QUERIES[name](spark, DATA).collect()}
    assert {j: pytest.approx(c, abs=2e-5) for j, c in centroids.items()} == got
