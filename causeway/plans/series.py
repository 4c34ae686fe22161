"""Queries of time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import functions as C
from causeway.operators import timeseries as T
from causeway.plans.registry import query

S = "round({}, {}) AS {}"
_KEY = ["concept", "indicator"]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("f1_epoch_to_ymd", """SELECT CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(day(t) AS INT) AS day, day(t) > 1 AS late, count(*) AS n FROM (SELECT make_timestamp(ts_ms * 1000) AS t FROM obs) GROUP BY ALL""", "obs")
def _(v):
    return v.obs.select(*[c.alias(k) for k, c in T.epoch_to_ymd(F.col("ts_ms")).items()]).groupBy("year", "month", "day", "late").agg(F.count("*").alias("n"))


@query("f2_steps_between", "SELECT l_orderkey, l_linenumber, CAST(12 * (year(l_shipdate) - 1995) + month(l_shipdate) - 1 AS INT) AS months, CAST(year(l_shipdate) - 1995 AS INT) AS years FROM lineitem")
def _(v):
    start = F.to_date(F.lit("1995-01-15"))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", C.steps_between(start, F.col("l_shipdate")).alias("months"), C.steps_between(start, F.col("l_shipdate"), "YEARLY").alias("years"))


@query("f3_num_timesteps", "SELECT o_orderkey, CAST(12 * (1999 - year(o_orderdate)) + 12 - month(o_orderdate) + 1 AS INT) AS n, CAST(12 * (1999 - year(o_orderdate)) + 12 - month(o_orderdate) AS INT) AS exclusive FROM orders")
def _(v):
    end = F.to_date(F.lit("1999-12-01"))
    return v.table("orders").select("o_orderkey", C.num_timesteps(F.col("o_orderdate"), end).alias("n"), C.num_timesteps(F.col("o_orderdate"), end, False).alias("exclusive"))


@query("f4_align_to_steps", """WITH t AS (SELECT o_orderpriority AS concept, o_orderdate AS d, o_totalprice AS value FROM orders) SELECT concept, CAST(12 * (year(d) - (SELECT year(min(d)) FROM t)) + month(d) - (SELECT month(min(d)) FROM t) AS INT) AS step, count(*) AS n, round(sum(value), 4) AS value FROM t GROUP BY ALL""")
def _(v):
    o = v.table("orders").select(F.col("o_orderpriority").alias("concept"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.col("o_totalprice").alias("value"))
    return rounded(T.align_to_steps(o).groupBy("concept", "step").agg(F.count("*").alias("n"), F.sum("value").alias("value")), "value", digits=4)


@query("f5_step_gaps", "SELECT * FROM (SELECT k, step, step - lag(step) OVER (PARTITION BY k ORDER BY step) AS gap FROM (SELECT DISTINCT o_custkey AS k, CAST(12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 1 AS INT) AS step FROM orders)) WHERE gap IS NOT NULL")
def _(v):
    return T.step_gaps(v.table("orders").select(F.col("o_custkey").alias("k"), C.steps_between(F.to_date(F.lit("1990-01-01")), F.col("o_orderdate")).alias("step")), ["k"])


@query("f6_month_axis", """SELECT CAST(m AS DATE) AS month, CAST(12 * year(m) + month(m) - 1 AS INT) AS step, year(m) || '-' || month(m) AS label, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2001-02-01', INTERVAL 1 MONTH)) AS m) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY ALL""")
def _(v):
    orders = v.table("orders").select(F.trunc("o_orderdate", "MM").alias("month"), "o_orderkey")
    return T.month_axis(v.spark, "1994-11-20", "2001-02-03").join(orders, "month", "left").groupBy("month", "step", "label").agg(F.count("o_orderkey").alias("n"))


@query("f7_monthly_means", "SELECT concept, step, round(avg(value) + 1e-7, 4) AS value FROM (SELECT DISTINCT concept FROM steps) CROSS JOIN (SELECT unnest(range(48, 144)) AS step) LEFT JOIN steps USING (concept, step) GROUP BY ALL", "steps")
def _(v):
    axis = v.spark.range(48, 144).select(F.col("id").alias("step"))
    means = T.monthly_means(v.steps, axis, ["concept"])
    return rounded(means.withColumn("value", F.col("value") + 1e-7), "value", digits=4)  # past ties, which engines round differently


_T = " + ".join(f"{term!r} / pow(count(*) - 1, {k})" for k, term in enumerate(T.expansion(1.959963984540054)))


@query("f8_mean_with_ci", f"SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - ({_T}) * stddev_samp(o_totalprice) / sqrt(count(*)), 2) AS lower, round(avg(o_totalprice) + ({_T}) * stddev_samp(o_totalprice) / sqrt(count(*)), 2) AS upper FROM orders GROUP BY 1")
def _(v):
    many = T.mean_with_ci(v.table("orders").select(F.col("o_orderpriority").alias("k"), "o_totalprice"), ["k"], "o_totalprice")
    return rounded(rounded(many, "mean", digits=4), "lower", "upper", digits=2)


@query("f9_season_bin", "SELECT CAST(step % 12 AS INT) AS bin, count(*) AS n FROM steps GROUP BY 1", "steps")
def _(v):
    return T.season_bin(v.steps, 12).groupBy("bin").agg(F.count("*").alias("n"))


_B = "b AS (SELECT concept, CAST(step % 12 AS INT) AS bin, step, value FROM means)"


@query("f10_season_profile_mean", f"WITH {_B} SELECT concept, bin, round(avg(value), 4) AS centre, round(coalesce(stddev_samp(value), 0), 4) AS spread FROM b GROUP BY ALL", "steps means")
def _(v):
    return rounded(T.season_profile(T.season_bin(v.means, 12), ["concept"]), "centre", "spread", digits=4)


@query("f10_season_profile_median", f"WITH {_B}, c AS (SELECT concept, bin, quantile_cont(value, 0.5) AS centre FROM b GROUP BY ALL) SELECT concept, bin, round(any_value(centre), 4) AS centre, round(quantile_cont(abs(value - centre), 0.5), 4) AS spread FROM b JOIN c USING (concept, bin) GROUP BY ALL", "steps means")
def _(v):
    return rounded(T.season_profile(T.season_bin(v.means, 12), ["concept"], "median"), "centre", "spread", digits=4)


_PROFILE = "p AS (SELECT concept, CAST(step % 12 AS INT) AS bin, avg(value) AS centre FROM means GROUP BY ALL)"


def _profile(v):
    return T.season_profile(T.season_bin(v.means, 12), ["concept"]).drop("spread")


@query("f11_circular_interpolate", f"""WITH {_PROFILE}, q AS (SELECT * FROM p WHERE bin NOT IN (0, 3, 4, 11)), bins AS (SELECT concept, CAST(b AS INT) AS bin FROM (SELECT DISTINCT concept FROM q), range(0, 12) t(b)), k AS (SELECT concept, bin + o AS at, centre FROM q, (SELECT unnest([-12, 0, 12]) AS o)),
    n AS (SELECT b.concept, b.bin, (SELECT max_by(struct_pack(at := k.at, v := k.centre), k.at) FROM k WHERE k.concept = b.concept AND k.at <= b.bin) AS lo, (SELECT min_by(struct_pack(at := k.at, v := k.centre), k.at) FROM k WHERE k.concept = b.concept AND k.at >= b.bin) AS hi FROM bins b)
    SELECT concept, bin, round(lo.v + (hi.v - lo.v) * (bin - lo.at) / greatest(hi.at - lo.at, 1), 4) AS centre FROM n""", "steps means")
def _(v):
    return rounded(T.circular_interpolate(_profile(v).where("bin NOT IN (0, 3, 4, 11)"), ["concept"], 12), "centre", digits=4)


@query("f12_season_changes", f"WITH {_PROFILE} SELECT a.concept, a.bin, round(b.centre - a.centre, 4) AS change FROM p a JOIN p b ON a.concept = b.concept AND b.bin = (a.bin + 1) % 12", "steps means")
def _(v):
    return rounded(T.season_changes(_profile(v), ["concept"], 12), "change", digits=4)


@query("f12_season_changes_relative", f"WITH {_PROFILE} SELECT a.concept, a.bin, round((b.centre - a.centre) / (a.centre + 1), 6) AS change FROM p a JOIN p b ON a.concept = b.concept AND b.bin = (a.bin + 1) % 12", "steps means")
def _(v):
    return rounded(T.season_changes(_profile(v), ["concept"], 12, True), "change")


@query("f13_season_sequence", f"WITH {_PROFILE} SELECT concept, CAST(s AS INT) AS step, round(least(greatest(centre, 100000), 200000), 3) AS value FROM p, range(0, 30) t(s) WHERE s % 12 = bin", "steps means")
def _(v):
    return rounded(T.season_sequence(_profile(v), ["concept"], 12, 30, "centre", 100000, 200000), "value", digits=3)


@query("f13_season_sequence_absolute", f"WITH {_PROFILE} SELECT concept, CAST(s AS INT) AS step, round(centre, 3) AS value FROM p, range(0, 30) t(s) WHERE s % 12 = bin", "steps means")
def _(v):
    return rounded(T.season_sequence(_profile(v), ["concept"], 12, 30, "absolute"), "value", digits=3)


@query("f13_season_sequence_relative", f"WITH {_PROFILE} SELECT concept, CAST(s AS INT) AS step, round(centre, 3) AS value FROM p, range(0, 30) t(s) WHERE s % 12 = bin", "steps means")
def _(v):
    return rounded(T.season_sequence(_profile(v), ["concept"], 12, 30, "relative"), "value", digits=3)


@query("f14_period_changes", "SELECT concept, CAST(pmod_ AS INT) AS bin, round(avg(c), 4) AS change FROM (SELECT concept, lag(step) OVER w % 12 AS pmod_, value - lag(value) OVER w AS c FROM means WINDOW w AS (PARTITION BY concept ORDER BY step)) WHERE pmod_ IS NOT NULL GROUP BY ALL", "steps means")
def _(v):
    return rounded(T.period_changes(v.means, ["concept"], 12), "change", digits=4)


@query("f15_relative_change", "SELECT concept, step, round((lead(value) OVER w - value) / nullif(value, 0), 6) AS change FROM means WINDOW w AS (PARTITION BY concept ORDER BY step)", "steps means")
def _(v):
    return rounded(T.relative_change(v.means, ["concept"], "step"), "change").select("concept", "step", "change")


@query("f16_midpoints", "SELECT concept, CAST(step % 12 AS INT) AS bin, round((value + n) / 2, 6) AS midpoint FROM (SELECT concept, step, value, lead(value) OVER w AS n, lead(step) OVER w AS s FROM means WINDOW w AS (PARTITION BY concept ORDER BY step)) WHERE s = step + 1", "steps means")
def _(v):
    return rounded(T.midpoints(v.means, ["concept"], 12), "midpoint")


@query("f17_year_month_matrix", "SELECT year, " + ", ".join(f"round(avg(value) FILTER (month = {m}), 6) AS m{m}" for m in range(1, 13)) + " FROM indicator GROUP BY 1", "indicator")
def _(v):
    return rounded(T.year_month_matrix(v.indicator), *[f"m{m}" for m in range(1, 13)])


_FILL = """axis AS (SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM range(1995, 2003) a(y), range(1, 13) b(m)), known AS (SELECT variable, year, month, value FROM indicator WHERE (year * 12 + month) % 5 > 0 AND year <> 1997),
    m AS (SELECT variable, year, month, avg(value) AS v FROM known GROUP BY ALL), y AS (SELECT variable, year, avg(value) AS v FROM known GROUP BY ALL), t AS (SELECT variable, avg(value) AS v FROM known GROUP BY ALL),
    filled AS (SELECT t.variable, year, month, coalesce(m.v, y.v, t.v) AS value FROM t CROSS JOIN axis LEFT JOIN m USING (variable, year, month) LEFT JOIN y USING (variable, year))"""


def _filled(v):
    axis = v.spark.range(1995, 2003).select(F.col("id").cast("int").alias("year"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return T.fill_months(v.indicator.where("(year * 12 + month) % 5 > 0 AND year <> 1997").select("variable", "year", "month", "value"), axis, ["variable"])


@query("f18_percent_deltas", f"""WITH {_FILL}, z AS (SELECT variable, year, month, CASE WHEN month IN (3, 4) THEN 0 ELSE value END AS value FROM filled), d AS (SELECT *, lead(value) OVER (PARTITION BY variable ORDER BY year, month) AS n FROM z),
    e AS (SELECT *, CASE WHEN value = 0 AND n = 0 THEN 0 WHEN value <> 0 THEN (n - value) / value END AS delta FROM d WHERE n IS NOT NULL), g AS (SELECT variable, abs(avg(delta)) AS a FROM e GROUP BY 1)
    SELECT variable, year, month, round(coalesce(delta, sign(n) * a), 6) AS delta FROM e JOIN g USING (variable)""", "indicator")
def _(v):
    zeroed = _filled(v).withColumn("value", F.when(F.col("month").isin(3, 4), 0.0).otherwise(F.col("value")))
    return rounded(T.percent_deltas(zeroed, ["variable"]), "delta")


@query("f19_true_values", f"WITH {_FILL} SELECT variable, year, month, round(value, 6) AS value FROM filled", "indicator")
def _(v):
    return rounded(_filled(v), "value")


@query("f20_split_by_periods", "SELECT concept, step, CASE WHEN row_number() OVER w <= 32 THEN 'train' WHEN row_number() OVER w <= 52 THEN 'validate' ELSE 'test' END AS part FROM means WINDOW w AS (PARTITION BY concept ORDER BY step)", "steps means")
def _(v):
    return T.split_by_periods(v.means, ["concept"], "step").select("concept", "step", "part")


@query("f21_plateau", """SELECT concept, min(step) AS step FROM (SELECT concept, step, row_number() OVER w AS rn, max(value) OVER b - min(value) OVER b AS r FROM means WINDOW w AS (PARTITION BY concept ORDER BY step), b AS (PARTITION BY concept ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE rn > 4 AND r <= 20000 GROUP BY 1""", "steps means")
def _(v):
    return T.plateau(v.means, ["concept"], "step", 4, 20000)
