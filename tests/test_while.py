"""While loops: what is staged and joined, and that no cell is lost by leaving a merge out."""

import pytest

from bagloom import workloads
from bagloom.api import Session
from bagloom.plans import loops
from bagloom.plans.loops import run_loops
from bagloom.plans.sql import run_sql

DATA = "/root/testdata/sf0.001"
ROUNDS = "var r: Int = 0; while (r < 3) { %s r += 1; };"


@pytest.fixture
def tables(monkeypatch):
    made, real = [], loops.staged

    def staged(df):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(loops, "staged", staged)
    return made


def test_pagerank_stages_its_edges_once_and_its_flow_before_it_is_read(spark, tables):
    workloads.QUERIES["loop_pagerank"](spark, DATA).collect()
    assert sum("lineitem" in p or "l_suppkey" in p for p in tables) == 4  # edges, nodes, out-degrees and first ranks, none in a round
    assert len(tables) == 4 + 3 * 2


def test_kmeans_makes_no_table_of_distances_and_no_sequence(spark, tables, monkeypatch):
    from bagloom.plans.sql import Texts

    texts, send = [], Texts.send
    monkeypatch.setattr(Texts, "send", lambda self, text: (texts.append(text), send(self, text))[1])
    workloads.QUERIES["sql_kmeans"](spark, DATA).collect()
    assert not any("_D " in t or "sequence(" in t for t in texts)
    assert not any("FULL OUTER JOIN" in t and "`j`" in t for t in texts)


@pytest.mark.parametrize("run", [run_loops, run_sql])
@pytest.mark.parametrize("body, want", [
    # cells of earlier rounds stay where the next one stores others
    ("for i = 0, 1 do A[i + 2 * r] := 1.0 * i;", {0: 0.0, 1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0}),
    ("for i = 0, 3 - r do A[i] := 1.0 * r;", {0: 2.0, 1: 2.0, 2: 1.0, 3: 0.0}),
    ("for i = 0, 3 do if (V[i] > 1.0 * r) A[i] := 1.0 * r;", {1: 0.0, 2: 1.0, 3: 2.0}),
    # a definition is not read any more when what it has read has changed
    ("for i = 0, 3 do A[i] := V[i] * 2.0; for i = 0, 3 do V[i] := V[i] + 1.0; for i = 0, 3 do B[i] := A[i];", {0: 4.0, 1: 6.0, 2: 8.0, 3: 10.0}),
    ("for i = 0, 1 do A[i] := V[i] * 2.0; for i = 0, 3 do B[i] := A[i];", {0: 0.0, 1: 2.0}),
    ("for i = 0, 3 do A[i] := 1.0; for i = 0, 1 do A[i] += V[i]; for i = 2, 5 do A[i] += 3.0;", {0: 1.0, 1: 2.0, 2: 4.0, 3: 4.0, 4: None, 5: None}),
])
def test_rounds_keep_their_cells(spark, run, body, want):
    v = spark.createDataFrame([(i, float(i)) for i in range(4)], "i long, v double")
    text = "var A: vector[Double] = vector(); var B: vector[Double] = vector(); " + ROUNDS % body
    found = run(text, {"spark": spark, "V": v}, Session())["B" if "B[i]" in body else "A"]
    got = {r[0]: r[1] for r in found.collect()}
    assert got.keys() == want.keys() and all(w is None or got[k] == w for k, w in want.items())


def test_repeat_stages_what_its_steps_read(spark, monkeypatch):
    from bagloom.plans import lower

    made, real = [], lower.staged
    monkeypatch.setattr(lower, "staged", lambda df: (made.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    workloads.QUERIES["pagerank"](spark, DATA).collect()
    assert sum("l_suppkey" in p for p in made) == 2 and len(made) == 2 + 4  # edges and nodes, then the start and a state for each round
