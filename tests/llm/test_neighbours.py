"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from causeway.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, cell int"


def brute(rows, queries, k):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [i for i, _ in rows if i % 100 == 0]
    got, want = found(neighbours.search(df, df.where("vec_id % 100 = 0"))), brute(rows, queries, 10)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(brute(rows, [q], len(rows))[q]) for q in queries[:3]}
    for q in exact:
        assert all(abs(exact[q][i] - s) < 1e-12 for i, s in got[q])


def test_small_tables_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_VECTORS", 8)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(0, 40)] + [(100, [1.0, 2.0, 0.6]), (101, [-1.0, 0.0, 3.0])]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, nan, 2.0]), (203, [inf, 1.0, 1.0]), (204, [1.0, None, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame([(i, v, 7, 7) for i, v in rows + bad], SCHEMA)
    asked = df.where("vec_id in (0, 5, 100, 101, 200, 201, 202)")
    want = brute(rows, [0, 5, 100, 101], 10)
    got = found(neighbours.search(df, asked))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = df.where("vec_id in (100, 101, 3)")
    assert [i for i, _ in found(neighbours.search(few, few))[101]] == [3, 100] or len(found(neighbours.search(few, few))[101]) == 2
    assert neighbours.search(df.limit(0), asked.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 3"), df.where("vec_id = 3")).count() == 0
    twice = df.where("vec_id in (1, 2)").union(df.where("vec_id in (1, 2)"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(twice, twice).collect()) == [(1, 1, 2), (2, 1, 1)]


def test_probes_come_in_order_of_cost():
    index = neighbours.Index(np.random.default_rng(0).normal(size=(1, neighbours.PROJECTIONS, 5)), np.zeros((1, neighbours.PROJECTIONS)), 1.0, 20)
    x = np.random.default_rng(1).normal(size=(3, 5))
    own = index.names(index.cells(x)[0])
    visits = index.visits(x)
    assert (visits[:, :, 0] == own).all() and all(len(set(v[0])) == 20 for v in visits.tolist())
