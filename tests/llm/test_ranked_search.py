"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from causeway.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(c.total() > 0 for _, c in counts), sum(c.total() for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    merged = {}
    for item, text in items:
        merged.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in merged.items():
        scored = []
        for i, c in counts:
            score = 0
            for t in asked & c.keys():
                m = 50 + (50 * c.total() * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, items, docs, k):
    a = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    b = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item int, path int").repartition(4)
    return sorted((tuple(r) for r in ranked_search.search(a, b, k).collect()), key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "été", "ÀB"]
    pick = lambda m: " ".join(draw.choices(words, [1 / (1 + i) for i in range(len(words))], k=m))
    return [(i, pick(draw.randint(1, 120))) for i in range(n)], [(i, pick(draw.randint(1, 30))) for i in range(12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, monkeypatch, seed):
    monkeypatch.setattr(ranked_search, "SHARD_COUNTS", 5000)
    monkeypatch.setattr(ranked_search, "LEAF_DOCUMENTS", 5)
    monkeypatch.setattr(ranked_search, "SAMPLE", 100)
    docs, items = corpus(600, seed)
    docs += [(10_000 + i, docs[7][1]) for i in range(200)]  # a group of copies, over several leaves and shards
    assert run(spark, items, docs, 20) == plain(items, docs, 20)


def test_nulls_ties_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, "?! .."), (None, "Alpha beta"), (5, "ALPHA beta"), (5, "alpha beta"), (6, "alpha-alpha " * 50_000), (7, "gamma"), (8, "alpha_beta")]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (None, "beta gamma"), (1, "beta"), (9, "alpha " * 1000)]
    assert run(spark, items, docs, 3) == plain(items, docs, 3)
    assert run(spark, items, docs, 50) == plain(items, docs, 50)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert run(spark, [], docs, 5) == run(spark, items, [], 5) == run(spark, items, [(1, None)], 5) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 100)
    docs, items = corpus(100, 3)
    assert run(spark, items, docs, 5) == plain(items, docs, 5)


def test_bounds_prune(monkeypatch):
    """Every node's bound is at least its best document's score, and an item skips most leaves."""
    monkeypatch.setattr(ranked_search, "LEAF_DOCUMENTS", 4)
    draw = np.random.default_rng(5)
    rows = sorted(tuple(sorted(draw.choice(40, draw.integers(1, 12), replace=False).tolist())) for _ in range(500))
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    path, count = np.concatenate(rows), draw.integers(1, 5, at[-1])
    root = ranked_search.grow(path, at, count, draw.integers(50, 90, 500))
    asked, weights = np.array([3, 17, 30, 39]), np.array([500, 4000, 5000, 6000])
    seen = []

    def walk(node):
        own = node.scores(asked, weights)
        if node.entries is None:
            seen.append(node)
            return own.max()
        below = [walk(e) for e in node.entries]
        assert all(b >= s for b, s in zip(own, below, strict=True))
        return max(below)

    top = walk(root)
    visited = []
    scores = ranked_search.Node.scores
    monkeypatch.setattr(ranked_search.Node, "scores", lambda self, *a: visited.append(self) or scores(self, *a))
    found, score = ranked_search.best(root, np.arange(500), asked, weights, 3, 0)
    assert score.max() == top and len(found) == 3
    assert sum(v.entries is None for v in visited) < len(seen) / 2


def test_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_ranked_search"]).fetchall()
    assert want and sorted(tuple(r) for r in queries.op13_ranked_search(spark, at).collect()) == sorted(want)
