"""Graph operators against enumeration."""

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import forecast, graph


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def acyclic(seed, n=8, share=0.4):
    draw = random.Random(seed)
    return {(f"v{a}", f"v{b}") for a in range(n) for b in range(a + 1, n) if draw.random() < share}


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_sums_over_paths(spark, seed):
    pairs, draw = acyclic(seed), random.Random(seed)
    theta = spark.createDataFrame([(d, a, b, draw.uniform(-1.5, 1.5)) for d in range(3) for a, b in sorted(pairs)], "draw int, src string, dst string, theta double")
    want = {r[:3]: r[3] for r in rows(graph.cell_values_on_paths(graph.simple_paths(edges(spark, pairs), 8), theta).select("draw", "src", "dst", "value"))}
    got = {r[:3]: r[3] for r in rows(graph.cell_values(theta).select("draw", "src", "dst", "value"))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_cells_of_more_paths_than_rows_could_hold(spark):
    """10 layers of 10 nodes: 10**8 paths from each node of the first layer to each of the last."""
    pairs = [(f"a{k}_{i}", f"a{k + 1}_{j}") for k in range(9) for i in range(10) for j in range(10)]
    theta = spark.createDataFrame([(1, a, b, math.atan(0.1)) for a, b in pairs], "draw int, src string, dst string, theta double")
    got = {r[:2]: r[2] for r in rows(graph.cell_values(theta).select("src", "dst", "value"))}
    assert len(got) == 100 * 45 and all(math.isclose(v, 0.1, rel_tol=1e-9) for v in got.values())


def test_cells_refuse_cycles(spark):
    theta = spark.createDataFrame([(1, a, b, 0.1) for a, b in (("a", "b"), ("b", "c"), ("c", "b"))], "draw int, src string, dst string, theta double")
    with pytest.raises(ValueError):
        graph.cell_values(theta)
    assert graph.cell_values(theta.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("cutoff", [1, 2, 3, 4, 5])
def test_two_sided_paths_equal_enumeration(spark, seed, cutoff):
    draw = random.Random(seed)
    pairs = {(f"v{a}", f"v{b}") for a in range(7) for b in range(7) if a != b and draw.random() < 0.35}
    ends = names(spark, "v0", "v1"), names(spark, "v1", "v5", "v6")
    every = graph.simple_paths(edges(spark, pairs), cutoff).where("src IN ('v0', 'v1') AND dst IN ('v1', 'v5', 'v6')")
    assert rows(graph.simple_paths(edges(spark, pairs), cutoff, *ends)) == rows(every)


def test_between_leaves_out_what_leads_nowhere(spark):
    """A hub of 3000 leaves on a cyclic graph: with both ends given, none of them makes a path."""
    pairs = {("a", "hub"), ("hub", "a"), ("hub", "b"), ("b", "hub"), ("b", "c")} | {("hub", f"leaf{k}") for k in range(3000)} | {(f"leaf{k}", f"leaf{k + 1}") for k in range(2999)}
    assert rows(graph.between(edges(spark, pairs), names(spark, "a"), names(spark, "c"), 5)) == [("a",), ("b",), ("c",), ("hub",)]
    assert rows(graph.simple_paths(edges(spark, pairs), 5, names(spark, "a"), names(spark, "c"), most=20)) == [("a", "c", ["a", "hub", "b", "c"])]


@pytest.mark.parametrize("cutoff", [1, 2, 3])
def test_prune_acyclic_equals_prune(spark, cutoff):
    pairs = acyclic(5, 9, 0.5)
    assert rows(graph.prune_acyclic(edges(spark, pairs), cutoff)) == rows(graph.prune(edges(spark, pairs), graph.simple_paths(edges(spark, pairs), 9), cutoff))


def test_common_ancestors_of_a_chain_and_a_fork(spark):
    chain = {(f"n{k:02}", f"n{k + 1:02}") for k in range(30)} | {("n10", "x"), ("x", "y"), ("n30", "z"), ("alone", "w")}
    pairs = spark.createDataFrame([("n30", "y"), ("z", "n02"), ("z", "z"), ("z", "w"), ("x", "n10")], "a string, b string")
    assert rows(graph.pair_common_ancestor(edges(spark, chain), pairs).select("a", "b", "ancestor")) == [("n30", "y", "n10"), ("x", "n10", "n10"), ("z", "n02", "n02"), ("z", "z", "z")]


@pytest.mark.parametrize("seed", [6, 7])
def test_common_ancestors_equal_the_definition(spark, seed):
    pairs = acyclic(seed, 10, 0.25)
    nodes = sorted({x for e in pairs for x in e})
    up = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            up[b] |= up[a]
    want = []
    for a in nodes:
        for b in nodes:
            common = up[a] & up[b]
            lowest = [c for c in common if not any(c != d and c in up[d] for d in common)]
            if lowest:
                want.append((a, b, min(lowest)))
    asked = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "a string, b string")
    assert rows(graph.pair_common_ancestor(edges(spark, pairs), asked).select("a", "b", "ancestor")) == sorted(want)


def test_k_hop_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 4)
    chain = edges(spark, {(f"n{k:02}", f"n{k + 1:02}") for k in range(15)})
    assert rows(graph.k_hop(chain, names(spark, "n00"))) == [(f"n{k:02}", k) for k in range(16)]


def test_clamps_of_many_nodes_and_two_steps(spark):
    """100 nodes over two steps, against the passes by hand; the plan doesn't grow with the clamps."""
    state = spark.createDataFrame([(f"p{k}", 1.0, 0.1) for k in range(100)] + [("q", 1.0, 0.2)], "name string, x0 double, d0 double")
    cells = spark.createDataFrame([(d, f"p{k}", "q", 0.01 * d) for d in (1, 2) for k in range(100)], "draw int, src string, dst string, value double")
    clamps = spark.createDataFrame([(f"p{k}", 2, 3.0 + k) for k in range(100)] + [("q", 4, 7.0), ("q", 4, -7.0), ("nobody", 2, 1.0), ("p0", 9, 1.0)], "name string, step int, value double")
    out = forecast.derivative_clamp(cells, state, forecast.displacements(state, 5), clamps, 5)
    got = {r[:3]: r[3] for r in rows(out.select("draw", "name", "step", "value"))}
    for d in (1, 2):
        moves = {f"p{k}": [0.0, 0.1] + [0.1 + (3.0 + k - 1.1) + (s - 2) * 0.1 for s in range(2, 6)] for k in range(100)}
        own = [0.2 * s for s in range(6)]
        pushed = [0.01 * d * sum(m[s] for m in moves.values()) for s in range(6)]
        base = own[3] + 7.0 - (1 + own[3] + pushed[3])
        own = own[:4] + [base + (s - 4) * 0.2 for s in (4, 5)]
        for s in range(6):
            assert math.isclose(got[d, "q", s], 1 + own[s] + pushed[s])
            assert all(math.isclose(got[d, f"p{k}", s], 1 + moves[f"p{k}"][s]) for k in range(100))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert out.groupBy("draw").agg(F.count("*")).count() == 2
