"""Hand-computed cases and properties of operators that SQL can't hold against."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway import functions as C
from causeway.operators import aggregate, clean, forecast, graph, lookup, priors, seasonal, sensitivity, statements, timeseries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


LOOP = [("tension", "crop"), ("crop", "food"), ("food", "aid"), ("aid", "food"), ("tension", "aid")]


def test_k_hop_and_between_with_a_loop(spark):
    g = edges(spark, LOOP)
    assert rows(graph.k_hop(g, names(spark, "tension"), 1)) == [("aid", 1), ("crop", 1), ("tension", 0)]
    assert rows(graph.k_hop(g, names(spark, "food"), -1, inward=True)) == [("aid", 1), ("crop", 1), ("food", 0), ("tension", 2)]
    assert rows(graph.between(g, names(spark, "tension"), names(spark, "food"), 2)) == [("aid",), ("crop",), ("food",), ("tension",)]
    assert rows(graph.between(g, names(spark, "tension"), names(spark, "crop"), 3)) == [("crop",), ("tension",)]


def test_prune_needs_more_than_one_longer_path(spark):
    g = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d"), ("b", "c")])
    assert rows(graph.prune(g, graph.simple_paths(g, 4), 2)) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]


def test_simple_paths_match_enumeration(spark):
    pick = random.Random(3)
    nodes = [f"v{k}" for k in range(6)]
    pairs = sorted({(a, b) for a in nodes for b in nodes if a != b and pick.random() < 0.4})
    want = sorted((p[0], p[-1], list(p)) for n in range(2, 5) for p in permutations(nodes, n) if all(e in pairs for e in zip(p, p[1:], strict=False)))
    assert sorted((r.src, r.dst, r.path) for r in graph.simple_paths(edges(spark, pairs), 3).collect()) == want
    with pytest.raises(ValueError):
        graph.simple_paths(edges(spark, pairs), 3, most=2)
    with pytest.raises(ValueError):
        graph.simple_paths(edges(spark, pairs), 0)


def test_levels_take_the_longest_way_and_refuse_cycles(spark):
    assert rows(graph.levels(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]))) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        graph.levels(edges(spark, [("a", "b"), ("b", "c"), ("c", "b")]), 5)


def test_blanket_places_side_inputs(spark):
    g = edges(spark, [("x", "f"), ("f", "y"), ("side", "f"), ("lit", "k"), ("k", "f"), ("c::IF_0", "f"), ("if", "c::IF_0"), ("cond", "if")])
    kinds = [("x", "variable", ""), ("y", "variable", ""), ("side", "variable", ""), ("k", "variable", ""), ("c::IF_0", "variable", ""), ("cond", "variable", ""), ("f", "function", "A"), ("lit", "function", "L"), ("if", "function", "C")]
    nodes = spark.createDataFrame(kinds, "name string, type string, label string")
    out = rows(graph.influence_blanket(g, nodes, names(spark, "x"), "y", 4))
    assert out == [("c::IF_0", "main"), ("cond", "blanket"), ("f", "main"), ("if", "main"), ("k", "main"), ("lit", "main"), ("side", "blanket")]


def test_linear_forecast_is_stepwise_multiplication(spark):
    pick = np.random.default_rng(5)
    n, steps = 5, 7
    cells = pick.normal(size=(n, n)) * (1 - np.eye(n))
    d = pick.normal(size=n)
    a = np.eye(2 * n)
    a[:n, n:] = cells + np.eye(n)
    state = np.concatenate([np.ones(n), d])
    want = []
    for _ in range(steps + 1):
        want.append(state[:n])
        state = a @ state
    cell_rows = [(0, f"v{j}", f"v{i}", float(cells[i, j])) for i in range(n) for j in range(n) if i != j]
    cell = spark.createDataFrame(cell_rows, "draw int, src string, dst string, value double")
    start = spark.createDataFrame([(f"v{i}", 1.0, float(d[i])) for i in range(n)], "name string, x0 double, d0 double")
    out = forecast.linear_forecast(cell, start, forecast.displacements(start, steps)).collect()
    assert len(out) == n * (steps + 1)
    for r in out:
        assert math.isclose(r.value, want[r.step][int(r.name[1:])], abs_tol=1e-9)


def test_map_concepts_by_rounds_match_brute_force(spark):
    pick = random.Random(9)
    concepts, indicators = [f"c{k}" for k in range(6)], [f"i{k}" for k in range(7)]
    scored = [(c, "s", i, pick.randrange(100) / 100) for c in concepts for i in indicators if pick.random() < 0.6]
    taken, want = set(), {}
    while True:
        free = [(s, c, i) for c, _, i, s in scored if i not in taken and len(want.get(c, [])) < 2]
        best = {}
        for s, c, i in sorted(free, key=lambda x: (-x[0], x[2])):
            best.setdefault(c, (s, i))
        won = {}
        for c, (s, i) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            won.setdefault(i, (c, s))
        if not won:
            break
        for i, (c, s) in won.items():
            taken.add(i)
            want.setdefault(c, []).append((i, s))
    nodes = spark.createDataFrame([(c,) for c in concepts], "concept string")
    mapped = lookup.map_concepts(nodes, spark.createDataFrame(scored, "concept string, source string, indicator string, score double"), spark.createDataFrame([(i.upper(),) for i in indicators], "variable string"), 2)
    assert sorted((r.concept, r.indicator, r.score) for r in mapped.collect()) == sorted((c, i, s) for c, x in want.items() for i, s in x)


def test_priors_sum_to_one_and_do_not_depend_on_partitions(spark):
    samples = spark.range(500).select((F.col("id") % 3).alias("e"), (F.sin("id") * 1.5).alias("theta"))
    prior = priors.theta_log_prior(samples, ["e"], 25)
    assert all(abs(r.s - 1) < 1e-9 for r in prior.groupBy("e").agg(F.sum(F.exp("log_prior")).alias("s")).collect())
    responses = spark.range(300).select((F.col("id") % 4).cast("string").alias("adjective"), (F.col("id") / 300).alias("response"))
    one, many = priors.smooth_resample(responses.repartition(1), 40, None, 7), priors.smooth_resample(responses.repartition(50), 40, None, 7)
    close = lambda df: [(a, k, round(x, 9)) for a, k, x in rows(df)]  # noqa: E731  the deviation's sum has an order
    assert close(one) == close(many)
    z = spark.range(20_000).select(C.normal(F.col("id"), seed=1).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(z.m) < 0.03 and abs(z.s - 1) < 0.03


def test_theta_at_zero_slopes(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1, 1), (0.0, -1.0, 1, 1), (0.0, 0.0, 1, 1), (1.0, 1.0, -1, 1)], "x double, y double, subj_pol int, obj_pol int")
    assert [round(r.theta, 4) for r in priors.theta_samples(df).collect()] == [1.5708, -1.5708, 0.0, -0.7854]


def test_fourier_fit_recovers_a_curve(spark):
    lam = 2 * math.pi / 12
    coef = [3.0, 0.7, -0.2, 0.4, 0.1]
    data = [("s", b, coef[0] + sum(coef[2 * w - 1] * math.sin(lam * w * b) + coef[2 * w] * lam * w * math.cos(lam * w * b) for w in (1, 2))) for b in range(12)]
    fit = seasonal.fourier_fit(spark.createDataFrame(data, "k string, bin int, value double"), ["k"], 12, 2).first().coef
    assert np.allclose(fit, coef)
    half = seasonal.fourier_fit(spark.createDataFrame(data, "k string, bin int, value double"), ["k"], 12, 6).first().coef
    assert len(half) == 13 and np.isfinite(half).all()


def test_fit_all_equals_a_plain_solver(spark):
    pick = np.random.default_rng(8)
    rows = [(k, b, float(pick.normal() + b % 5)) for k in ("s", "t") for b in range(12) for _ in range(int(pick.integers(1, 5)))]
    mids = [(k, b, float(pick.normal())) for k in ("s", "t") for b in range(12)]
    out = seasonal.fit_all(spark.createDataFrame(rows, "k string, bin int, value double").withColumnRenamed("k", "series"), spark.createDataFrame(mids, "series string, bin int, midpoint double"), ["series"], 12, 6)
    got = {(r.series, r.k): r.rmse for r in out.collect()}

    def terms(at, k):
        return np.array([[1.0] + [f(math.pi / 6 * w * b) * s for w in range(1, k + 1) for f, s in ((math.sin, 1), (math.cos, math.pi / 6 * w))] for b in at])

    assert len(got) == 14
    for (key, k), rmse in got.items():
        mine, points = [r for r in rows if r[0] == key], [m for m in mids if m[0] == key]
        coef = np.linalg.lstsq(terms([r[1] for r in mine], k), np.array([r[2] for r in mine]), rcond=1e-8)[0]
        error = terms([m[1] + 0.5 for m in points], k) @ coef - np.array([m[2] for m in points])
        assert math.isclose(rmse, math.sqrt((error**2).mean()), rel_tol=1e-6)


def test_expanded_quantile_meets_the_integrated_one():
    z = 1.959963984540054
    assert all(abs(sum(t / n**k for k, t in enumerate(timeseries.expansion(z))) - timeseries.t_quantile(0.975, n)) < 1e-7 for n in (150, 199))


def test_season_sequences_compound(spark):
    p = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0), ("s", 2, 0.5)], "k string, bin int, centre double")
    for model in ("absolute", "relative", "centre"):
        assert [round(r.value, 9) for r in timeseries.season_sequence(p, ["k"], 3, 5, model).orderBy("step").collect()] == [1.0, 3.0, 0.5, 1.0, 3.0]


def test_interval_and_t_quantile(spark):
    assert abs(timeseries.t_quantile(0.975, 1) - 12.7062) < 1e-3 and abs(timeseries.t_quantile(0.975, 10) - 2.2281) < 1e-4 and abs(timeseries.t_quantile(0.975, 60) - 2.0003) < 1e-4
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, value double")
    out = {r.k: r for r in timeseries.mean_with_ci(df, ["k"]).collect()}
    assert abs(out["a"].upper - (2 + 4.302653 / math.sqrt(3))) < 1e-4 and out["b"].lower is None and out["b"].mean == 5 and out["c"].mean is None
    s = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2, 3)], "value double").withColumn("k", F.lit(1))
    r = forecast.credible_interval(s, ["k"]).first()
    assert (r.median, r.lower, r.upper) == (3.0, 1.0, 5.0)


def test_sobol_of_a_linear_function(spark):
    design = sensitivity.design_table(spark.range(20_000), {"a": [0, 1], "b": [0, 1]}, seed=1)
    out = {r.variable: r for r in sensitivity.sobol_indices(design.select("id", "block", (F.col("a") + 2 * F.col("b")).alias("y")), ["a", "b"]).collect()}
    assert abs(out["a"].s1 - 0.2) < 0.1 and abs(out["b"].s1 - 0.8) < 0.1 and abs(out["b"].st - 0.8) < 0.03
    assert sensitivity.clean_bounds({"x": [3], "y": [1, 0], "z": [2, 4]}) == {"x": (0.0, 1.0), "y": (0.0, 1.0), "z": (2.0, 4.0)}
    with pytest.raises(ValueError):
        sensitivity.clean_bounds({})


def test_expected_distribution_refuses_two_units(spark):
    df = spark.createDataFrame([(1.0, "kg"), (2.0, "t")], "v double, u string")
    assert aggregate.expected_distribution(df, "v", 0, 1.5, "u").count() == 1
    with pytest.raises(ValueError):
        aggregate.expected_distribution(df, "v", 0, 5, "u")


def test_merge_flips_and_drops_loops(spark):
    e = spark.createDataFrame([("a", "b", 1, 1), ("a", "c", 1, -1), ("c", "a", 1, 1)], "subj string, obj string, subj_pol int, obj_pol int")
    assert rows(statements.merge_nodes(e, "a", "b", False)) == [("b", "c", -1, -1), ("c", "b", 1, -1)]


def test_clean_handles_nulls_and_ties(spark):
    df = spark.createDataFrame([("2010-2012", 5.0, "x"), ("2011", 7.0, "x"), ("2011", 7.0, None)], "year string, value double, k string")
    assert sorted(str(tuple(r)) for r in clean.expand_year_range(df).collect()) == sorted(map(str, [(2010, 5.0, "x"), (2011, 7.0, "x"), (2012, 5.0, "x"), (2011, 7.0, None)]))
    texts = spark.createDataFrame([("1,234",), ("x",), (None,)], "v string")
    assert rows(clean.parse_numbers(texts, "v")) == [(1234.0,)]
    assert spark.range(1).select(C.camel_words(F.lit("CropYieldUSA2018")).alias("w")).first().w == "Crop Yield USA 2018"


def test_random_graph_is_connected(spark):
    g = forecast.random_graph(spark.range(0, 90, 3), 0.5, seed=2)
    assert g.count() > 29 and g.where("src >= dst").isEmpty()
    both = g.union(g.select("dst", "src")).selectExpr("cast(src as string) src", "cast(dst as string) dst")
    assert graph.k_hop(both, names(spark, "0")).count() == 30


def test_lookups_against_filters_row_by_row(spark):
    """Both lookups, the county among their keys, against a walk over all observations for each request."""
    import random

    from causeway.operators import lookup

    pick = random.Random(4)
    keys = ["country", "state", "county", "unit", "year", "month"]
    choices = {"country": ["A", "B", None], "state": ["S", "T", None], "county": ["x", "y", None], "unit": ["kg", "t"], "year": [1, 2], "month": [0, 1, 2]}
    wanted = {**choices, "unit": ["kg", "lb", None], "year": [1, 3, None], "month": [1, 2, 5, None]}
    data = [(pick.choice("vw"), *[pick.choice(choices[k]) for k in keys], float(i)) for i in range(120)]
    ask = [(i, pick.choice("vwz"), *[pick.choice(wanted[k]) for k in keys]) for i in range(80)]
    kinds = "variable string, country string, state string, county string, unit string, year int, month int"
    indicator, requests = spark.createDataFrame(data, f"{kinds}, value double"), spark.createDataFrame(ask, f"request int, {kinds}")

    def strict(r):
        def found(month):
            rows = [d for d in data if d[0] == r[1] and all(r[2 + k] is None or d[1 + k] == r[2 + k] for k in range(5)) and month(d)]
            return [d[7] for d in rows if d[4] == min(x[4] for x in rows)]

        exact, annual = found(lambda d: r[7] is None or d[6] == r[7]), found(lambda d: d[6] == 0)
        return exact or [min(annual) / 12 if annual else None]

    def cascade(r):
        rows = [d for d in data if d[0] == r[1]]
        for k in range(6):
            want = r[2 + k]
            if k == 3 and rows and not any(d[4] == want for d in rows):
                want = min(d[4] for d in rows)
            rows = [d for d in rows if want is not None and d[1 + k] == want] or rows
        return [d[7] for d in rows]

    def same(df, plain):
        rows = sorted((x.request, x.value is None, x.value or 0) for x in df.collect())
        assert rows == sorted((r[0], v is None, v or 0) for r in ask for v in plain(r))

    same(lookup.lookup_strict(requests, indicator), strict)
    same(lookup.lookup_cascade(requests, indicator), cascade)
    assert lookup.lookup_cascade(requests.limit(0), indicator).count() == 0 == lookup.lookup_strict(requests.limit(0), indicator).count()
