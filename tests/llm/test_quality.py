"""The quality ranker: held-out accuracy, its weights against a plain solver, and edge cases."""

import zlib

import numpy as np

from causeway.llm import quality

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    out = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [(r.score, r.quality, r.predicted) for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    up, down = np.array([s for s, q, _ in held if q == 1]), np.array([s for s, q, _ in held if q == 0])
    assert len(up) > 20 and len(down) > 5
    assert ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2) > 0.95
    assert np.mean([q == p for _, q, p in held]) > 0.95 and all((s >= 0.5) == (p == 1) for s, _, p in held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end quality")
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_weights_against_gradient_descent():
    """The Newton steps end where the loss of all drawn pairs has no slope."""
    pick = np.random.default_rng(2)
    x = pick.normal(size=(160, len(quality.FEATURES)))
    good = x[:, 0] + 0.5 * x[:, 1] + pick.normal(size=160) > 0
    found = quality.fit_preferences(x, good)
    z = np.clip((x - found.mean) / found.spread, -8, 8)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    pick = np.random.default_rng(17)
    i = np.concatenate([np.repeat(up, quality.PAIRS_A_ROW), pick.choice(up, len(down) * quality.PAIRS_A_ROW)])
    j = np.concatenate([pick.choice(down, len(up) * quality.PAIRS_A_ROW), np.repeat(down, quality.PAIRS_A_ROW)])
    w = np.zeros(len(quality.FEATURES))
    d = z[i] - z[j]
    for _ in range(6000):
        w -= 0.5 * (1e-2 * w - (d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0))
    assert np.allclose(w, found.weights, atol=1e-3)
    assert (found.score(x) >= 0.5).sum() == good.sum()


def test_labels_of_one_kind_or_none():
    x = np.random.default_rng(1).normal(size=(8, len(quality.FEATURES)))
    assert (quality.fit_preferences(x, np.ones(8, bool)).score(x) == 0.5).all()
    assert (quality.fit_preferences(x, np.zeros(8, bool)).score(x) < 1e-9).all()
    assert (quality.fit_preferences(x[:0], np.zeros(0, bool)).score(x) == 0.5).all()


def test_nulls_repeats_empty_and_clashing_names(spark):
    rows = [(1, "fine words here", 7), (1, "fine words here", 8), (None, "", 9), (2, None, 9), (3, "!!! $$$ " * 50_000, 9)]
    docs = spark.createDataFrame([(i, t, s, 0.5, [1.0]) for i, t, s in rows], "doc_id long, text string, score_of int, quality double, features array<double>")
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 0), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).count() == 5
