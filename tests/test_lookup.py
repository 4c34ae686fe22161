"""Lookups against plain Python, and what they make of many requests or extents."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import lookup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def granted(scored, n):
    """Claims in the order of score, concept and indicator."""
    taken, held = set(), {}
    for c, i, s in sorted(scored, key=lambda x: (-x[2], x[0], x[1])):
        if i not in taken and len(held.get(c, [])) < n:
            taken.add(i)
            held.setdefault(c, []).append((i, s))
    return sorted((c, k + 1, i, s) for c, x in held.items() for k, (i, s) in enumerate(x))


def mapped(spark, scored, n):
    concept_map = spark.createDataFrame([(c, "s", i, s) for c, i, s in scored], "concept string, source string, indicator string, score double")
    data = concept_map.selectExpr("upper(indicator) variable").distinct()
    return rows(lookup.map_concepts(concept_map.select("concept"), concept_map, data, n, in_order=True))


def test_a_better_second_claim_comes_before_a_worse_first_one(spark):
    scored = [("a", "v1", 0.7), ("b", "v2", 0.9), ("b", "v1", 0.8)]
    assert mapped(spark, scored, 2) == [("b", 1, "v2", 0.9), ("b", 2, "v1", 0.8)]
    assert mapped(spark, [*scored, ("c", "v2", 0.95)], 1) == [("b", 1, "v1", 0.8), ("c", 1, "v2", 0.95)]


@pytest.mark.parametrize(("seed", "n", "scores"), [(1, 1, 20), (2, 2, 20), (3, 3, 3), (4, 2, 1)])
def test_claims_are_granted_in_order(spark, seed, n, scores):
    pick = random.Random(seed)
    scored = [(f"c{c}", f"i{i}", pick.randrange(scores) / 10) for c in range(7) for i in range(9) if pick.random() < 0.7]
    assert mapped(spark, scored, n) == granted(scored, n)


KEYS = "variable string, country string, state string, county string, unit string, year int, month int"


def lookups(spark, seed):
    """Requests and observations with nulls among their keys and values, some by year alone, many that ask the same."""
    pick = random.Random(seed)
    key = lambda gap: (pick.choice("ab"), *[pick.choice([None] * gap + [f"{c}1", f"{c}2"]) for c in "xyzu"], pick.choice([None] * gap + [2000, 2001]), pick.choice([None] * gap + [0, 1, 2]))
    requests = spark.createDataFrame([(k, *key(2)) for k in range(400)] + [(900, None, *[None] * 6), (901, "c", *[None] * 6)], f"request int, {KEYS}")
    indicator = spark.createDataFrame([(*key(k % 2), pick.choice([None, 1.0, 2.5, 7.0])) for k in range(150)], f"{KEYS}, value double")
    return requests, indicator


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_are_those_of_the_rows(spark, seed):
    requests, indicator = lookups(spark, seed)
    close = F.round(F.sum("value"), 6).alias("total")
    strict = lookup.lookup_strict(requests, indicator).groupBy("request").agg(F.count("value").alias("n"), close)
    assert rows(lookup.lookup_strict_totals(requests, indicator).withColumn("total", F.round("total", 6))) == rows(strict)
    cascade = lookup.lookup_cascade(requests, indicator).groupBy("request").agg(F.count("*").alias("n"), close)
    assert rows(lookup.lookup_cascade_totals(requests, indicator).withColumn("total", F.round("total", 6))) == rows(cascade)


def most_rows(df):
    """The most rows that one step of the executed plan of df puts out."""
    df.collect()
    out, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(plan.plan())
        made = plan.metrics().get("numOutputRows")
        out.append(made.get().value() if made.isDefined() else 0)
        children = plan.children()
        left += [children.apply(k) for k in range(children.size())]
    return max(out)


@pytest.mark.parametrize("name", ["d3_lookup_strict", "d4_lookup_cascade"])
def test_matches_are_not_rows(spark, tmp_path, name):
    """Ten times the requests and observations: a hundred times the matches, but not the rows of any step."""
    from causeway.plans import registry

    for t in ("nation", "region", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    times = spark.range(10).withColumnRenamed("id", "__k")
    for t, key in {"orders": "o_orderkey", "lineitem": "l_orderkey"}.items():
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        df.crossJoin(times).withColumn(key, F.col(key) + 84 * 1000 * F.col("__k")).drop("__k").write.parquet(f"{tmp_path}/{t}.parquet")
    query = registry.queries()[name]
    few, many = (most_rows(query(spark, d)) for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert many <= 12 * few
    assert many <= 4 * spark.read.parquet(f"{tmp_path}/orders.parquet").count()


def extents(spark, seed, n, side, repeats):
    pick = random.Random(seed)
    boxes = [(x := pick.randrange(-60, 60), y := pick.randrange(-60, 60), x + pick.randrange(-1, side), y + pick.randrange(side)) for _ in range(n)]
    told = [(k, *map(float, boxes[k % n])) for k in range(n * repeats)]
    return told, spark.createDataFrame(told, "id long, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("repeats", [1, 3])
def test_overlaps_are_those_of_all_pairs(spark, repeats):
    (a, left), (b, right) = extents(spark, 5, 80, 30, repeats), extents(spark, 6, 90, 70, repeats)
    thin = [(k, x0 + 0.25, y0 + 0.25, x1 - 0.25, y1 - 0.25) for k, x0, y0, x1, y1 in a]
    fine = lambda e: e[1] <= e[3] and e[2] <= e[4]
    want = [(e[0], f[0]) for e in thin for f in b if fine(e) and fine(f) and e[1] <= f[3] and f[1] <= e[3] and e[2] <= f[4] and f[2] <= e[4]]
    assert rows(lookup.extent_overlap(left, right, 20, 0.25)) == sorted(want, key=repr)


def test_a_pair_of_extents_is_one_row_however_many_cells_it_shares(spark):
    side = spark.range(300).selectExpr("id", "0.0D x0", "0.0D y0", "50.0D x1", "50.0D y1")
    own = side.withColumns({c: F.col(c) + F.col("id") / 1000 for c in ("x0", "y0", "x1", "y1")})
    for a in (side, own):
        assert most_rows(lookup.extent_overlap(a, a, 10)) == 90_000
