"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import aggregate as A
from causeway.plans.registry import query

_PER = "per AS (SELECT concept, indicator, step, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM steps GROUP BY ALL)"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("e1_sum_by_period", "SELECT year, month, state, variable, round(sum(value), 6) AS value FROM indicator GROUP BY ALL", "indicator")
def _(v):
    return rounded(A.sum_by_period(v.indicator, "state", "variable"), "value")


@query("e2_month_end_rollup", "SELECT o_orderstatus, CAST(last_day(o_orderdate) AS DATE) AS month_end, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY ALL")
def _(v):
    return rounded(A.month_end_rollup(v.table("orders").withColumnRenamed("o_totalprice", "value"), "o_orderdate", ["o_orderstatus"]), "value", digits=4)


@query("e3_mean_by_market", "SELECT state, month, round(avg(value), 6) AS value FROM indicator GROUP BY ALL", "indicator")
def _(v):
    return rounded(A.mean_by_market(v.indicator, ["state", "month"]), "value")


@query("e4_block_sums", """WITH d AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY day) AS rn, count(*) OVER (PARTITION BY year) AS n FROM d)
    SELECT year, (rn - 1) // 10 AS block, round(sum(value), 4) AS value FROM n WHERE rn <= 10 * (n // 10) GROUP BY ALL""")
def _(v):
    daily = v.table("orders").groupBy(F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(A.block_sums(daily, ["year"], ["day"], 10), "value", digits=4)


@query("e5_obs_per_step", f"WITH {_PER} SELECT concept, indicator, step, round(mean, 4) AS mean, round(sd, 4) AS sd, n FROM per", "steps")
def _(v):
    return rounded(A.obs_per_step(v.steps), "mean", "sd", digits=4)


for _method, _expr in {"first": "min_by(mean, step)", "last": "max_by(mean, step)", "min": "min(mean)", "max": "max(mean)", "mean": "avg(mean)", "median": "quantile_cont(mean, 0.5)"}.items():

    @query(f"e6_scaling_factor_{_method}", f"WITH {_PER} SELECT concept, indicator, round({_expr}, 4) AS scale, round(coalesce(max(sd), 1), 4) AS sd FROM per GROUP BY ALL", "steps")
    def _(v, method=_method):
        return rounded(A.scaling_factor(A.obs_per_step(v.steps), method), "scale", "sd", digits=4)


@query("e7_concept_moments", f"WITH {_PER}, s AS (SELECT concept, indicator, avg(mean) AS scale FROM per GROUP BY ALL) SELECT concept, round(avg(mean / scale), 6) AS mean, round(stddev_samp(mean / scale), 6) AS sd FROM per JOIN s USING (concept, indicator) GROUP BY ALL", "steps")
def _(v):
    per = A.obs_per_step(v.steps)
    return rounded(A.concept_moments(per, A.scaling_factor(per, "mean")), "mean", "sd")


@query("e8_scaled_bounds", "SELECT c_custkey AS k, round(CASE WHEN c_acctbal > 0 THEN 10 / c_acctbal ELSE 500 / c_acctbal END, 6) AS low, round(CASE WHEN c_acctbal > 0 THEN 500 / c_acctbal ELSE 10 / c_acctbal END, 6) AS high FROM customer WHERE c_acctbal <> 0")
def _(v):
    scales = v.table("customer").where("c_acctbal <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("scale"))
    return rounded(A.scaled_bounds(scales, F.lit(10), F.lit(500)), "low", "high").drop("scale")


@query("e9_modal_gap", """WITH d AS (SELECT DISTINCT o_orderpriority AS k, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders), g AS (SELECT k, d - lag(d) OVER (PARTITION BY k ORDER BY d) AS gap FROM d), c AS (SELECT k, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL)
    SELECT k, CAST(min(gap) AS INT) AS shortest, CAST(max(gap) AS INT) AS longest, CAST((list(gap ORDER BY n DESC, gap))[1] AS INT) AS gap, max(n) AS n FROM c GROUP BY k""")
def _(v):
    days = v.table("orders").select(F.col("o_orderpriority").alias("k"), F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01")).alias("d"))
    return A.modal_gap(days, ["k"], "d")


@query("e10_infer_period", """WITH d AS (SELECT DISTINCT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS d FROM orders), g AS (SELECT k, d - lag(d) OVER (PARTITION BY k ORDER BY d) AS gap FROM d)
    SELECT k, min(gap) AS gap, CAST(CASE WHEN min(gap) = 1 THEN 365 WHEN min(gap) = 7 THEN 52 WHEN min(gap) IN (28, 29, 30, 31) THEN 12 WHEN min(gap) IN (59, 60, 61, 62) THEN 6 WHEN min(gap) IN (89, 90, 91, 92) THEN 4 WHEN min(gap) IN (120, 121, 122, 123) THEN 3 WHEN min(gap) IN (181, 182, 183, 184) THEN 2 ELSE 1 END AS INT) AS period FROM g GROUP BY k""")
def _(v):
    return A.infer_period(v.table("orders").select(F.col("o_custkey").alias("k"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms")), ["k"], "ms")


@query("e10_common_period", "SELECT CAST(list_reduce(list(DISTINCT p), lambda a, b: lcm(a, b)) AS BIGINT) AS period FROM (SELECT CAST([12, 52, 4, 6][o_orderkey % 4 + 1] AS BIGINT) AS p FROM orders)")
def _(v):
    return A.common_period(v.table("orders").select(F.element_at(F.array(*map(F.lit, (12, 52, 4, 6))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("period")))


@query("e11_train_window", 'SELECT min(ts_ms) AS start, max(ts_ms) AS "end" FROM obs', "obs")
def _(v):
    return A.train_window(v.obs, "ts_ms")


@query("e12_node_degrees", "SELECT name, sum(i) AS n_in, sum(o) AS n_out, sum(i + o) AS degree, sum(i) = 0 AS is_input, sum(o) = 0 AS is_output FROM (SELECT src AS name, 0 AS i, 1 AS o FROM dag UNION ALL SELECT dst, 1, 0 FROM dag) GROUP BY 1", "edges dag")
def _(v):
    return A.node_degrees(v.dag)


@query("e13_head_body_split", "SELECT name, name NOT IN (SELECT dst FROM dag) AS is_head FROM (SELECT src AS name FROM dag UNION SELECT dst FROM dag)", "edges dag")
def _(v):
    return A.head_body_split(v.dag.select(F.col("src").alias("name")).union(v.dag.select("dst")).distinct(), v.dag)


@query("e14_edge_evidence", """WITH r AS (SELECT subj, obj, stmt, evid, count(*) OVER (PARTITION BY subj, obj) AS n, (row_number() OVER (PARTITION BY subj, obj ORDER BY stmt, evid) - 1) // 50 AS part FROM evidence WHERE subj <> obj)
    SELECT subj, obj, n, part, string_agg(stmt || ':' || evid, ',' ORDER BY stmt, evid) AS pieces FROM r GROUP BY ALL""", "evidence")
def _(v):
    parts = A.edge_evidence(v.evidence, [], size=50)
    return parts.select("subj", "obj", "n", "part", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["stmt"], e["evid"])), ",").alias("pieces"))


@query("e15_edge_reinforcement", "SELECT subj, obj, round(avg(subj_pol * obj_pol), 6) AS reinforcement FROM evidence WHERE subj <> obj GROUP BY ALL", "evidence")
def _(v):
    return rounded(A.edge_reinforcement(v.evidence), "reinforcement")


@query("e16_first_evidence", """SELECT subj, obj, subj_adj, obj_adj, subj_pol, obj_pol FROM evidence WHERE subj <> obj QUALIFY row_number() OVER (PARTITION BY subj, obj ORDER BY stmt, evid, subj_adj NULLS FIRST, obj_adj NULLS FIRST, subj_pol, obj_pol) = 1""", "evidence")
def _(v):
    return A.first_evidence(v.evidence)


@query("e17_filter_funnel", 'SELECT count(*) AS "all", count(*) FILTER (belief > 0.93) AS believed, count(*) FILTER (belief > 0.93 AND subj_score > 0.5) AS grounded, count(*) FILTER (belief > 0.93 AND subj_score > 0.5 AND subj_adj IS NOT NULL) AS described FROM evidence', "evidence")
def _(v):
    return A.filter_funnel(v.evidence, {"believed": F.col("belief") > 0.93, "grounded": F.col("subj_score") > 0.5, "described": F.col("subj_adj").isNotNull()})


_ADJ = "adj AS (SELECT CASE WHEN subj_adj IS NULL THEN [] WHEN evid % 2 = 0 THEN [subj_adj, 'big'] ELSE [subj_adj] END AS subj_adjs, CASE WHEN obj_adj IS NULL THEN [] ELSE [obj_adj] END AS obj_adjs FROM evidence), roles AS (SELECT 'subj_adjs' AS role, subj_adjs AS a FROM adj UNION ALL SELECT 'obj_adjs', obj_adjs FROM adj)"


def _adjectives(v):
    none = F.array().cast("array<string>")
    s = F.when(F.col("subj_adj").isNull(), none).when(F.col("evid") % 2 == 0, F.array("subj_adj", F.lit("big"))).otherwise(F.array("subj_adj"))
    return v.evidence.select(s.alias("subj_adjs"), F.when(F.col("obj_adj").isNull(), none).otherwise(F.array("obj_adj")).alias("obj_adjs"))


@query("e18_adjective_multiplicity", f"WITH {_ADJ} SELECT role, CAST(len(a) AS INT) AS size, count(*) AS n FROM roles GROUP BY ALL", "evidence")
def _(v):
    return A.adjective_multiplicity(_adjectives(v), ["subj_adjs", "obj_adjs"])


@query("e19_adjective_frequency", f"WITH {_ADJ} SELECT role, adjective, count(*) AS n FROM (SELECT role, unnest(CASE WHEN len(a) = 0 THEN ['None'] ELSE a END) AS adjective FROM roles) GROUP BY ALL", "evidence")
def _(v):
    return A.adjective_frequency(_adjectives(v), ["subj_adjs", "obj_adjs"])


@query("e20_adjective_pairs", f"WITH {_ADJ} SELECT subj_adj, obj_adj, count(*) AS n FROM (SELECT subj_adj, unnest(CASE WHEN len(o) = 0 THEN ['None'] ELSE o END) AS obj_adj FROM (SELECT unnest(CASE WHEN len(subj_adjs) = 0 THEN ['None'] ELSE subj_adjs END) AS subj_adj, obj_adjs AS o FROM adj)) GROUP BY ALL", "evidence")
def _(v):
    return A.adjective_pairs(_adjectives(v), "subj_adjs", "obj_adjs")


@query("e21_grounding_inventory", """WITH d AS (SELECT DISTINCT p_type AS leaf, p_name AS t FROM part), r AS (SELECT leaf, t, count(*) OVER (PARTITION BY leaf) AS n, (row_number() OVER (PARTITION BY leaf ORDER BY t) - 1) // 20 AS part FROM d)
    SELECT leaf, n, part, string_agg(t, '|' ORDER BY t) AS texts FROM r GROUP BY ALL""")
def _(v):
    texts = v.table("part").select(F.concat(F.lit("wm/x/"), "p_type").alias("g"), "p_name")
    return A.grounding_inventory(texts, "g", "p_name", size=20).withColumn("texts", F.array_join("texts", "|"))


@query("e22_inspection_table", "SELECT subj, obj, obj_adj, round(avg(subj_pol), 6) AS subj_pol, round(avg(obj_pol), 6) AS obj_pol FROM evidence GROUP BY ALL", "evidence")
def _(v):
    return rounded(A.inspection_table(v.evidence, ["subj", "obj", "obj_adj"]), "subj_pol", "obj_pol")


@query("e23_timing_summary", "SELECT nodes, edges, kind, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(stddev_samp({c}), 4) AS {c}_sd" for c in ("wall", "cpu")) + " FROM timings GROUP BY ALL", "timings")
def _(v):
    return A.timing_summary(v.timings)


@query("e24_speedup", "SELECT o_orderkey, round(o_totalprice - o_custkey, 6) AS diff, round((o_totalprice - o_custkey) * 100 / o_totalprice, 6) AS percent, round(CASE WHEN o_custkey <> 0 THEN o_totalprice / o_custkey + 1e-7 END, 4) AS fold FROM orders")
def _(v):
    return rounded(rounded(A.speedup(v.table("orders"), "o_totalprice", "o_custkey").withColumn("fold", F.col("fold") + 1e-7), "diff", "percent"), "fold", digits=4).select("o_orderkey", "diff", "percent", "fold")


@query("e24_mean_by_kind", "SELECT nodes, edges, round(avg(wall) FILTER (kind = 'F'), 4) AS F, round(avg(wall) FILTER (kind = 'O'), 4) AS O FROM timings GROUP BY ALL", "timings")
def _(v):
    return rounded(A.mean_by_kind(v.timings, ["nodes", "edges"], "kind", ["F", "O"], "wall"), "F", "O", digits=4)


_DIFF = "WITH d AS (SELECT (o_orderkey * 7 % 5) - (o_orderkey * 3 % 4) AS diff FROM orders)"


@query("e25_regression_diff", f"{_DIFF} SELECT diff, count(*) AS n FROM d GROUP BY 1")
def _(v):
    o = v.table("orders")
    return A.regression_diff(o.selectExpr("o_orderkey", "o_orderkey * 3 % 4 ll"), o.selectExpr("o_orderkey", "o_orderkey * 7 % 5 ll"), ["o_orderkey"], "ll")[0]


@query("e25_regression_moments", f"{_DIFF} SELECT round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS sd FROM d")
def _(v):
    o = v.table("orders")
    return rounded(A.regression_diff(o.selectExpr("o_orderkey", "o_orderkey * 3 % 4 ll"), o.selectExpr("o_orderkey", "o_orderkey * 7 % 5 ll"), ["o_orderkey"], "ll")[1], "mean", "sd")


@query("e26_coincident_counts", "SELECT step, round(value, 0) AS v, count(*) AS n FROM steps GROUP BY ALL", "steps")
def _(v):
    return A.coincident_counts(v.steps.select("step", F.round("value", 0).alias("v")), "step", "v")


@query("e27_histogram", "SELECT CAST(least(floor((l_quantity - 1) / (49.0 / 7)), 6) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def _(v):
    return A.histogram(v.table("lineitem"), "l_quantity", 1, 50, 7)


@query("e28_value_frequency", "SELECT concept, round(value / 1000, 0) AS rounded, count(*) AS n FROM steps GROUP BY ALL", "steps")
def _(v):
    return A.value_frequency(v.steps.withColumn("value", F.col("value") / 1000), ["concept"], "value")


@query("e29_percentile_conditional", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.1) FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def _(v):
    return A.percentile_conditional(v.table("lineitem"), "l_extendedprice", 0.1, F.col("l_returnflag") == "R").groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("e30_expected_distribution", "SELECT state, count(*) AS n, round(sum(value), 6) AS total FROM indicator WHERE unit = 'O' AND value BETWEEN 10 AND 20 GROUP BY 1", "indicator")
def _(v):
    return A.expected_distribution(v.indicator.where("unit = 'O'"), "value", 10, 20, "unit").groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("e31_month_regression", """WITH m AS (SELECT variable, year, month, avg(value) AS value FROM indicator GROUP BY ALL), x AS (SELECT *, CASE WHEN lead(year * 12 + month) OVER w = year * 12 + month + 1 THEN lead(value) OVER w END AS nxt FROM m WINDOW w AS (PARTITION BY variable ORDER BY year * 12 + month))
    SELECT variable, month, round(regr_slope(value, year), 4) AS slope, round(regr_intercept(value, year), 2) AS intercept, round(regr_slope(nxt, value), 4) AS next_slope, round(regr_intercept(nxt, value), 4) AS next_intercept FROM x GROUP BY ALL""", "indicator")
def _(v):
    m = v.indicator.groupBy("variable", "year", "month").agg(F.avg("value").alias("value"))
    out = A.month_regression(m, ["variable"])
    return rounded(rounded(out, "slope", "next_slope", "next_intercept", digits=4), "intercept", digits=2)


@query("e32_month_moments", "SELECT variable, month, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM indicator GROUP BY ALL", "indicator")
def _(v):
    return rounded(A.month_moments(v.indicator, ["variable"], "month"), "mean", "sd")
