"""Near duplicates of embeddings against brute force."""

import numpy as np
import pytest

from causeway.llm import graph_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, node int, copies int, links int"


def plain(rows, threshold):
    """vec_id, n_links, component_id and kept of each row, by all pairs."""
    ok = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for group in {(rows[k][2], len(rows[k][1])) for k in ok}:
        some = [k for k in ok if (rows[k][2], len(rows[k][1])) == group]
        x = np.array([rows[k][1] for k in some], float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        near = np.argwhere(np.triu(x @ x.T >= threshold, 1))
        for a, b in near.tolist():
            links[some[a]] += 1
            links[some[b]] += 1
            root[find(some[a])] = find(some[b])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in graph_dedup.near_duplicates(df, **kw).collect()), key=repr)


def planted(n, dimension, seed):
    """Directions without near ones, groups of near ones of 2 to 200, copies, chains."""
    draw = np.random.default_rng(seed)
    x = list(draw.normal(size=(n, dimension)))
    for size, spread in ((2, 0.1), (2, 0.2), (5, 0.15), (30, 0.2), (200, 0.15)):
        middle = draw.normal(size=dimension)
        x += list(middle + spread * draw.normal(size=(size, dimension)))
    x += [x[3]] * 40 + [2 * x[4]] * 3
    at = draw.normal(size=dimension)
    for _ in range(30):
        at = at + 0.3 * draw.normal(size=dimension)
        x.append(at)
    order = draw.permutation(len(x))
    return [(int(i), [float(c) for c in v], int(i % 3 == 0)) for i, v in zip(order, x, strict=True)]


def test_equals_all_pairs(spark):
    rows = planted(800, 32, 1)
    assert run(spark, rows, threshold=0.93) == plain(rows, 0.93)


def test_overlapping_clusters_and_parts(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "CLUSTER_VECTORS", 200)
    monkeypatch.setattr(graph_dedup, "PART_VECTORS", 150)
    rows = planted(1500, 32, 2)
    got, want = run(spark, rows, threshold=0.93), plain(rows, 0.93)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # no link below the threshold, none twice
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    near = [(10_000_000 + i, [c + 0.001 * (k % 7) for k, c in enumerate(v)], label) for i, v, label in rows[::10]]
    both = df.select("vec_id", "embedding", "label").union(spark.createDataFrame(near, "vec_id long, embedding array<float>, label int"))
    stored = [(r.vec_id, r.embedding, r.label) for r in both.collect()]
    assert sorted(map(tuple, graph_dedup.near_duplicates(both).collect()), key=repr) == plain(stored, 0.93)


def test_nulls_lengths_and_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1),
        (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.01], 1), (None, v, 1), (None, [-5.0, 1.0, 1.0], 1), (14, [1e200, 2e200, 3e200], 1), (15, [1e-200, 2e-200, 3e-200], 1),
    ]
    got = run(spark, rows)
    linked = {1: 6, 2: 6, 3: 6, 14: 6, 15: 6, 12: 1, 13: 1}
    assert len(got) == len(rows)
    for i, links, component, kept in got:
        if i is None:
            assert (links, component, kept) in ((6, 1, False), (0, None, True))
        else:
            assert links == linked.get(i, 0)
            assert component == (1 if links == 6 else 12 if links else i) and kept == (i == component)


def test_empty(spark):
    assert run(spark, []) == []


def test_pruning_drops_what_a_nearer_one_covers():
    draw = np.random.default_rng(3)
    u = graph_dedup.units(draw.normal(size=(300, 16)))
    near = graph_dedup.pruned(u)
    assert near.shape == (300, graph_dedup.DEGREE + graph_dedup.DRAWN) and (near != np.arange(300)[:, None]).all()
    for p in range(0, 300, 50):
        own = near[p, : graph_dedup.DEGREE]
        own = own[own >= 0]
        far = np.sqrt(np.maximum(2 - 2 * u[own] @ u[p], 0))
        assert (np.diff(far) >= -1e-5).all()
        for k in range(1, len(own)):
            assert (graph_dedup.ALPHA * np.sqrt(np.maximum(2 - 2 * u[own[:k]] @ u[own[k]], 0)) > far[k] - 1e-4).all()
