"""Scans, neighbours and order statistics against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from causeway.operators import aggregate, forecast, scan, timeseries


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "a", "a", "a", "b", None]), k, draw.choice([None, *range(40)]), draw.random()) for k in range(3000)] + [("one", 5000, 1, 0.5)]
    df = spark.createDataFrame(rows, "k string, at int, v int, x double").repartition(7)
    return df, {k: sorted(g, key=lambda r: r[1]) for k, g in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")), key=lambda r: r[0])}


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_numbered(table):
    df, by = table
    want = [(k, r[1], i, len(g)) for k, g in by.items() for i, r in enumerate(g)]
    assert told(scan.numbered(df, ["k"], ["at"]), "k", "at", "index", "n") == sorted(want, key=repr)


def test_pairwise_across_chunks(table):
    df, by = table
    want = [(k, r[1], g[i + 1][1] if i + 1 < len(g) else None) for k, g in by.items() for i, r in enumerate(g)]
    assert told(scan.pairwise(df, ["k"], ["at"], ["at"], chunk=10), "k", "at", "next_at") == sorted(want, key=repr)


def test_grouper_and_take(table):
    df, by = table
    want = [(k, r[1], i // 7) for k, g in by.items() for i, r in enumerate(g)]
    assert told(scan.grouper(df, ["k"], ["at"], 7), "k", "at", "group") == sorted(want, key=repr)
    assert told(scan.take(df, ["k"], ["at"], 3), "k", "at") == sorted(((k, r[1]) for k, g in by.items() for r in g[:3]), key=repr)


def test_running_across_chunks(table):
    df, by = table
    want = []
    for k, g in by.items():
        total = None
        for r in g:
            total = total if r[2] is None else (total or 0) + r[2]
            want.append((k, r[1], total))
    assert told(scan.running(df, ["k"], ["at"], "v", chunk=16), "k", "at", "scan") == sorted(want, key=repr)


def test_gaps_and_plateau_across_chunks(table, monkeypatch):
    df, by = table
    want = []
    for k, g in by.items():
        some = sorted({r[1] // 3 for r in g})
        want += [(k, b, b - a) for a, b in zip(some, some[1:], strict=False)]
    assert told(scan.gaps(df.withColumn("t", F.floor(F.col("at") / 3)), ["k"], "t", chunk=8), "k", "t", "gap") == sorted(want, key=repr)
    monkeypatch.setattr(scan.neighbourly, "__defaults__", (0, 0, 12))
    flat = [(k, min(r[1] for i, r in enumerate(g) if i >= 4 and max(x[3] for x in g[i - 4 : i]) - min(x[3] for x in g[i - 4 : i]) <= 0.1)) for k, g in by.items() if len(g) > 4]
    assert told(timeseries.plateau(df, ["k"], "at", 4, 0.1, "x"), "k", "at") == sorted(flat, key=repr)
    with pytest.raises(ValueError):
        scan.neighbourly(df, ["k"], ["at"], before=13)


def test_order_statistics(table):
    df, by = table
    tally = scan.Tally.of(df, ["k"], "v")
    assert told(tally.sizes(), "k", "n") == sorted(((k, len(g)) for k, g in by.items()), key=repr)
    wanted = tally.sizes().select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("rank"))
    ordered = {k: sorted((r[2] for r in g), key=lambda v: (v is not None, v or 0)) for k, g in by.items()}
    assert told(tally.at(wanted), "k", "rank", "value") == sorted(((k, i, v) for k, g in ordered.items() for i, v in enumerate(g)), key=repr)


def test_interval_of_one_key_is_spread(spark):
    """One key: no task after the first shuffles holds more than a few times the mean."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("value"))
    tally = scan.Tally.of(df, ["k"], "value")
    sizes = [r["count"] for r in tally.rows.groupBy("__part").count().collect()]
    assert len(sizes) >= 2 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    got = forecast.credible_interval(df, ["k"]).first()
    values = sorted(r.value for r in df.collect())
    n = len(values)
    assert (got.lower, got.upper) == (values[int((n - 1.96 * n**0.5) // 2)], values[int((2 + n + 1.96 * n**0.5) // 2)])
    assert got.median == pytest.approx((values[n // 2] + values[n // 2 - 1]) / 2)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, at int, v double")
    assert scan.numbered(df, ["k"], ["at"]).collect() == scan.running(df, ["k"], ["at"], "v").collect() == []
    assert forecast.credible_interval(df, ["k"], "v").collect() == []
    assert aggregate.modal_gap(df, ["k"], "at").collect() == []
