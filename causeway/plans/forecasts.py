"""Queries of forecasts, sensitivity and scalar helpers."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway import functions as C
from causeway.operators import graph, scan, sensitivity
from causeway.operators import forecast as K
from causeway.operators import timeseries as T
from causeway.plans.graphs import cells_sql
from causeway.plans.registry import normal_sql, query, uniform_sql
from causeway.plans.series import rounded
from causeway.sources.writers import write_table

_NODES = "nd AS (SELECT src AS name FROM dag UNION SELECT dst FROM dag), st AS (SELECT name, 1.0::DOUBLE AS x0, CAST(ascii(right(name, 1)) % 11 AS DOUBLE) / 20 AS d0 FROM nd)"
_LINEAR = _NODES + """, cell AS (SELECT draw, src, dst, sum(p) AS value FROM f GROUP BY ALL), ax AS (SELECT CAST(s AS INT) AS step FROM range(0, 7) t(s)),
    lin AS (SELECT d.draw, st.name, ax.step, st.x0 + ax.step * st.d0 + coalesce((SELECT sum(c.value * ax.step * o.d0) FROM cell c JOIN st o ON c.src = o.name WHERE c.draw = d.draw AND c.dst = st.name), 0) AS value FROM (SELECT DISTINCT draw FROM cell) d, st, ax)"""


def _cells(v):
    return write_table(graph.cell_values(v.draws), "cells")


def _state(v):
    names = v.dag.select(F.col("src").alias("name")).union(v.dag.select("dst")).distinct()
    return K.initial_state(names).withColumn("d0", (F.ascii(F.right("name", F.lit(1))) % 11).cast("double") / 20)


def _linear(v):
    return K.linear_forecast(_cells(v), _state(v), K.displacements(_state(v), 6))


_RANKS = """r AS (SELECT {key}, value, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {t})
    SELECT {key}, round(avg(value) FILTER (r = n // 2 OR (n % 2 = 0 AND r = n // 2 - 1)), 6) AS median, round(max(value) FILTER (r = greatest(0, floor((n - 1.96 * sqrt(n)) / 2))), 6) AS lower, round(max(value) FILTER (r = least(n - 1, floor((2 + n + 1.96 * sqrt(n)) / 2))), 6) AS upper FROM r GROUP BY ALL"""


@query("flagship_monthly_summary", "WITH s AS (SELECT variable, 12 * year + month - 1 AS step, value FROM indicator), " + _RANKS.format(key="variable, step", t="s"), "indicator")
def _(v):
    steps = v.indicator.select("variable", C.month_index(F.col("year"), F.col("month")).alias("step"), "value")
    return rounded(K.credible_interval(steps, ["variable", "step"]), "median", "lower", "upper")


@query("k1_initial_state", f"WITH {_NODES} SELECT name, x0, 0.0::DOUBLE AS d0 FROM st", "edges dag")
def _(v):
    return K.initial_state(_state(v).select("name"))


@query("k2_linear_forecast", cells_sql(f", {_LINEAR} SELECT draw, name, step, round(value, 6) AS value FROM lin").replace(" , nd AS", ", nd AS"))
def _(v):
    return rounded(_linear(v), "value")


@query("k3_emit_indicator", "SELECT c_custkey, 'balance' AS indicator, round(c_acctbal * (c_nationkey + 1), 6) AS value FROM customer")
def _(v):
    c = v.table("customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("name"), F.col("c_acctbal").alias("value"))
    scales = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.lit("balance").alias("indicator"), (F.col("n_nationkey") + 1.0).alias("scale"))
    return rounded(K.emit_indicator(c, scales).drop("name"), "value")


_INC = "inc AS (SELECT concept, step, value - lag(value) OVER (PARTITION BY concept ORDER BY step) AS inc FROM means), i2 AS (SELECT concept, CAST(row_number() OVER (PARTITION BY concept ORDER BY step) AS INT) AS step, coalesce(inc, 0) AS inc FROM inc)"


def _increments(v):
    w = Window.partitionBy("concept").orderBy("step")
    return v.means.select("concept", F.row_number().over(w).alias("step"), F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)).alias("inc"), F.lit(150000.0).alias("x0"))


@query("k4_bounded_forecast", f"""WITH RECURSIVE steps AS (SELECT 1), means AS (SELECT o_orderpriority AS concept, 12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 1 AS step, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(o_totalprice) / 100 AS value FROM orders GROUP BY ALL), {_INC},
    walk AS (SELECT concept, step, least(greatest(150000 + inc, 120000), 220000) AS x FROM i2 WHERE step = 1 UNION ALL SELECT w.concept, i.step, least(greatest(w.x + i.inc, 120000), 220000) FROM walk w JOIN i2 i ON i.concept = w.concept AND i.step = w.step + 1) SELECT concept, step, CAST(x AS DOUBLE) AS value FROM walk""")
def _(v):
    return K.bounded_forecast(_increments(v), ["concept"], F.lit(120000.0), F.lit(220000.0))


_ATT = "att AS (SELECT DISTINCT n_name AS concept, 'i' || n_nationkey AS indicator, n_nationkey + 1.0 AS scale FROM nation WHERE n_nationkey < 20)"


def _constraints(v):
    attached = v.table("nation").where("n_nationkey < 20").select(F.col("n_name").alias("concept"), F.concat(F.lit("i"), "n_nationkey").alias("indicator"), (F.col("n_nationkey") + 1.0).alias("scale"), F.lit(0).alias("place"))
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("i"), "n_nationkey")).when(F.col("s_suppkey") % 3 == 2, F.concat(F.lit("i"), F.col("s_suppkey") % 30))
    return K.constraint_rows(s.select(F.col("n_name").alias("concept"), F.col("s_suppkey").cast("int").alias("step"), F.col("s_acctbal").alias("value"), named.alias("indicator")), attached)


_CON = f"{_ATT}, con AS (SELECT n_name AS concept, CAST(s_suppkey AS INT) AS step, s_acctbal AS value, CASE s_suppkey % 3 WHEN 1 THEN 'i' || n_nationkey WHEN 2 THEN 'i' || (s_suppkey % 30) END AS indicator FROM supplier JOIN nation ON s_nationkey = n_nationkey), jn AS (SELECT con.*, f.indicator AS fi, coalesce(con.indicator, f.indicator) AS i, a.scale FROM con LEFT JOIN att f ON f.concept = con.concept LEFT JOIN att a ON a.concept = con.concept AND a.indicator = coalesce(con.indicator, f.indicator))"


@query("k5_constraint_rows", f"WITH {_CON} SELECT concept, i AS indicator, step + 1 AS step, round(value / scale, 6) AS value FROM jn WHERE scale IS NOT NULL")
def _(v):
    return rounded(_constraints(v)[0], "value")


@query("k5_constraint_rejects", f"WITH {_CON} SELECT concept, step, CASE WHEN fi IS NULL THEN 'no such concept or no indicator' WHEN i NOT IN (SELECT indicator FROM att) THEN 'no such indicator' ELSE 'not attached to the concept' END AS reason FROM jn WHERE scale IS NULL")
def _(v):
    return _constraints(v)[1].select("concept", "step", "reason")


_CLAMP = f"{_INC}, cl AS (SELECT *, CASE WHEN step % 9 = 4 THEN 100000.0 + step END AS s FROM i2), h AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY concept ORDER BY step) AS held, count(s) OVER (PARTITION BY concept ORDER BY step) AS part FROM cl)"


def _clamped(v, perpetual):
    inc = _increments(v)
    clamps = inc.where("step % 9 = 4").select("concept", "step", (F.lit(100000.0) + F.col("step")).alias("value"))
    return rounded(K.value_clamp(inc, clamps, ["concept"], perpetual), "value", digits=3)


@query("k6_value_clamp_one_off", f"WITH {_CLAMP} SELECT concept, step, round(coalesce(held, 150000) + sum(CASE WHEN s IS NULL THEN inc ELSE 0 END) OVER (PARTITION BY concept, part ORDER BY step), 3) AS value FROM h", "steps means")
def _(v):
    return _clamped(v, False)


@query("k6_value_clamp_perpetual", f"WITH {_CLAMP} SELECT concept, step, round(coalesce(held, 150000 + sum(inc) OVER (PARTITION BY concept ORDER BY step)), 3) AS value FROM h", "steps means")
def _(v):
    return _clamped(v, True)


@query("k7_derivative_clamp", cells_sql(f""", {_LINEAR}, moved AS (SELECT d.draw, st.name, ax.step, CASE WHEN st.name = (SELECT min(name) FROM hd) AND ax.step >= 3 THEN 2 * st.d0 + (5 - (1 + 2 * st.d0)) + (ax.step - 3) * st.d0 ELSE ax.step * st.d0 END AS disp FROM (SELECT DISTINCT draw FROM cell) d, st, ax)
    SELECT m.draw, m.name, m.step, round(1 + m.disp + coalesce((SELECT sum(c.value * o.disp) FROM cell c JOIN moved o ON c.src = o.name AND o.draw = m.draw AND o.step = m.step WHERE c.draw = m.draw AND c.dst = m.name), 0), 6) AS value FROM moved m""").replace(" , nd AS", ", hd AS (SELECT src AS name FROM dag EXCEPT SELECT dst FROM dag), nd AS"))
def _(v):
    heads = v.dag.select(F.col("src").alias("name")).join(v.dag.select(F.col("dst").alias("name")), "name", "left_anti")
    clamps = heads.agg(F.min("name").alias("name")).select("name", F.lit(3).alias("step"), F.lit(5.0).alias("value"))
    state = _state(v)
    return rounded(K.derivative_clamp(_cells(v), state, K.displacements(state, 6), clamps, 6), "value")


_TWO = """cl AS (SELECT name, CASE WHEN name LIKE 'c%' THEN 2 ELSE 4 END AS step, CASE WHEN name LIKE 'c%' THEN 2.5 ELSE -1.5 END AS value FROM nd WHERE name LIKE 'n%' OR name LIKE 'c%1'),
    m0 AS (SELECT d.draw, st.name, ax.step, ax.step * st.d0 AS disp, st.d0 FROM (SELECT DISTINCT draw FROM cell) d, st, ax),
    {passes}
    SELECT m.draw, m.name, m.step, round(1 + m.disp + coalesce(p.push, 0), 6) AS value FROM m2 m LEFT JOIN (SELECT c.draw, c.dst, o.step, sum(c.value * o.disp) AS push FROM cell c JOIN m2 o ON c.src = o.name AND o.draw = c.draw GROUP BY ALL) p ON p.draw = m.draw AND p.dst = m.name AND p.step = m.step"""
_PASS = """x{k} AS (SELECT m.draw, m.name, m.disp + cl.value - (1 + m.disp + coalesce((SELECT sum(c.value * o.disp) FROM cell c JOIN m{j} o ON c.src = o.name AND o.draw = c.draw AND o.step = {t} - 1 WHERE c.draw = m.draw AND c.dst = m.name), 0)) AS reached FROM m{j} m JOIN cl ON cl.name = m.name AND cl.step = {t} WHERE m.step = {t} - 1),
    m{k} AS (SELECT m.draw, m.name, m.step, CASE WHEN x.reached IS NOT NULL AND m.step >= {t} THEN x.reached + {after} ELSE m.disp END AS disp, m.d0 FROM m{j} m LEFT JOIN x{k} x ON x.draw = m.draw AND x.name = m.name)"""


def _clamp_table_sql(perpetual):
    after = "0" if perpetual else "(m.step - {t}) * m.d0"
    passes = ", ".join(_PASS.format(k=k, j=k - 1, t=t, after=after.format(t=t)) for k, t in ((1, 2), (2, 4)))
    return cells_sql(f", {_LINEAR}, {_TWO.format(passes=passes)}").replace(" , nd AS", ", nd AS")


for _name, _perpetual in {"one_off": False, "perpetual": True}.items():

    @query(f"k7_clamp_table_{_name}", _clamp_table_sql(_perpetual))
    def _(v, perpetual=_perpetual):
        state = _state(v)
        low = F.col("name").startswith("c")
        clamps = state.where("name LIKE 'n%' OR name LIKE 'c%1'").select("name", F.when(low, 2).otherwise(4).alias("step"), F.when(low, 2.5).otherwise(-1.5).alias("value"))
        return rounded(K.derivative_clamp(_cells(v), state, K.displacements(state, 6), clamps, 6, perpetual), "value")


@query("k8_head_constraint", "SELECT concept AS name, step, CASE WHEN step % 10 = 0 THEN 1 ELSE value END AS value FROM means", "steps means")
def _(v):
    seq = v.means.select(F.col("concept").alias("name"), "step", "value")
    return K.head_constraint(seq, seq.where("step % 10 = 0").withColumn("value", F.lit(1.0)))


@query("k9_forecast_format", "SELECT indicator, step, '2000-' || step AS label, CAST(row_number() OVER (PARTITION BY indicator, step ORDER BY value) AS INT) AS rank, value FROM forecast WHERE step > 0", "forecast")
def _(v):
    axis = T.month_axis(v.spark, "2000-01-01", "2000-12-01").select((F.col("step") - 12 * 2000 + 1).alias("step"), "label")
    return K.forecast_format(v.forecast, axis, ["indicator"])


@query("k10_forecast_window", """WITH q AS (SELECT o_orderkey, DATE '1995-03-01' AS train_start, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 5 > 0 THEN DATE '1998-06-01' END AS e FROM orders), p AS (SELECT *, coalesce(s, DATE '1995-04-01') AS st FROM q)
    SELECT o_orderkey, CASE WHEN e >= st THEN CAST(12 * (year(st) - 1995) + month(st) - 3 AS INT) END AS first_step, CASE WHEN e >= st THEN CAST(12 * (1998 - year(st)) + 6 - month(st) + 1 AS INT) END AS steps, CASE WHEN e IS NULL THEN 'no end' WHEN e < st THEN 'ends before it starts' END AS reason FROM p""")
def _(v):
    q = v.table("orders").select("o_orderkey", F.to_date(F.lit("1995-03-01")).alias("train_start"), F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")).alias("start"), F.when(F.col("o_orderkey") % 5 > 0, F.to_date(F.lit("1998-06-01"))).alias("end"))
    return K.forecast_window(q).select("o_orderkey", "first_step", "steps", "reason")


@query("k11_indicator_samples", "SELECT step, count(*) AS n, round(sum(value), 2) AS total FROM forecast WHERE indicator = 'R' GROUP BY 1", "forecast")
def _(v):
    return K.indicator_samples(v.forecast, "R").groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_LL = "fc AS (SELECT indicator, step, CAST(sample % 8 AS INT) AS draw, avg(value) AS x FROM forecast GROUP BY ALL), ob AS (SELECT indicator, step, avg(value) AS y, stddev_samp(value) AS sd FROM forecast GROUP BY ALL), ll AS (SELECT draw, sum(-0.5 * ln(2 * pi()) - ln(sd) - 0.5 * pow((y - x) / sd, 2)) AS ll FROM fc JOIN ob USING (indicator, step) GROUP BY 1)"


def _likelihood(v):
    fc = v.forecast.groupBy("indicator", "step", (F.col("sample") % 8).cast("int").alias("draw")).agg(F.avg("value").alias("value"))
    ob = v.forecast.groupBy("indicator", "step").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("sd"))
    return K.log_likelihood(fc, ob)


@query("k12_log_likelihood", f"WITH {_LL} SELECT draw, round(ll, 6) AS ll FROM ll", "forecast")
def _(v):
    return rounded(_likelihood(v), "ll")


@query("k13_best_draw", f"WITH {_LL} SELECT draw, round(ll, 6) AS ll FROM ll ORDER BY ll.ll DESC, draw LIMIT 1", "forecast")
def _(v):
    return rounded(K.best_draw(_likelihood(v)), "ll")


@query("k14_posterior_weights", f"WITH {_LL}, e AS (SELECT draw, ll, exp(ll - (SELECT max(ll) FROM ll)) AS e FROM ll) SELECT draw, round(ll, 6) AS ll, round(e / (SELECT sum(e) FROM e), 6) AS weight FROM e", "forecast")
def _(v):
    return rounded(K.posterior_weights(_likelihood(v)), "ll", "weight")


@query("k15_credible_interval", "WITH " + _RANKS.format(key="indicator, step", t="forecast"), "forecast")
def _(v):
    return rounded(K.credible_interval(v.forecast, ["indicator", "step"]), "median", "lower", "upper")


@query("k16_forecast_rmse", "SELECT l_returnflag, round(sqrt(avg(pow(l_extendedprice - 30000, 2))), 4) AS rmse FROM lineitem GROUP BY 1")
def _(v):
    return rounded(K.forecast_rmse(v.table("lineitem").select("l_returnflag", (F.col("l_extendedprice") - 30000).alias("error")), ["l_returnflag"]), "rmse", digits=4)


@query("k17_forecast_timestamps", "SELECT o_orderkey, CAST(i AS INT) AS i, CAST(round(o_orderkey * 1000.0 + (o_totalprice * 400) * i / 4) AS BIGINT) AS stamp FROM orders, range(0, 5) t(i)")
def _(v):
    q = v.table("orders").select("o_orderkey", (F.col("o_orderkey") * 1000.0).alias("start"), (F.col("o_orderkey") * 1000.0 + F.col("o_totalprice") * 400).alias("end"), F.lit(5).alias("n"))
    return K.forecast_timestamps(q).select("o_orderkey", "i", "stamp")


@query("k18_intervention_effect", cells_sql(""", cell AS (SELECT draw, src, dst, sum(p) AS value FROM f GROUP BY ALL), ef AS (SELECT draw, dst AS name, step, sum(value * 0.1 * step) AS p FROM cell, (SELECT CAST(s AS INT) AS step FROM range(1, 5) t(s)) GROUP BY ALL)
    SELECT name, step, round(1 + avg(p), 6) AS predicted, 1.0::DOUBLE AS "true", round(pow(avg(p), 2), 6) AS squared FROM ef GROUP BY ALL""").replace(" , cell AS", ", cell AS"))
def _(v):
    names = v.dag.select(F.col("src").alias("name")).union(v.dag.select("dst")).distinct()
    deltas = names.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("delta", F.lit(0.1))
    return rounded(K.intervention_effect(_cells(v), deltas, deltas.select("name", "step", F.lit(1.0).alias("value"))), "predicted", "squared")


@query("k19_walk_forward_backtest", """WITH w AS (SELECT CAST(unnest([60, 66, 72]) AS INT) AS start), f AS (SELECT concept, start, regr_slope(value, step) AS b, regr_intercept(value, step) AS a FROM means, w WHERE step >= start AND step < start + 24 GROUP BY ALL)
    SELECT concept, start, round(sqrt(avg(pow(a + b * step - value, 2))), 2) AS rmse FROM means JOIN f USING (concept) WHERE step >= start + 24 AND step < start + 30 GROUP BY ALL""", "steps means")
def _(v):
    return rounded(K.walk_forward_backtest(v.means, ["concept"], 24, 6, [60, 66, 72]), "rmse", digits=2)


@query("k20_synthetic_obs", cells_sql(f", {_LINEAR} SELECT draw, name, step, round(value + 0.1 * {normal_sql('draw', 'name', 'step', seed=3)}, 6) AS value FROM lin").replace(" , nd AS", ", nd AS"))
def _(v):
    return rounded(K.synthetic_obs(_linear(v), 0.1, seed=3), "value")


@query("k21_random_graph", f"""WITH w AS (SELECT c_custkey AS id, CAST(floor({uniform_sql('c_custkey', seed=4)} * c_custkey) AS BIGINT) AS t FROM customer UNION ALL SELECT c_custkey, CAST(floor({uniform_sql('c_custkey', seed=6)} * c_custkey) AS BIGINT) FROM customer WHERE {uniform_sql('c_custkey', seed=5)} < 0.2)
    SELECT DISTINCT coalesce(c_custkey, (SELECT min(c_custkey) FROM customer)) AS src, id AS dst FROM w LEFT JOIN customer ON c_custkey = t WHERE coalesce(c_custkey, (SELECT min(c_custkey) FROM customer)) <> id""")
def _(v):
    return K.random_graph(v.table("customer").select(F.col("c_custkey").alias("id")), 0.2, seed=4)


_BOUNDS = {"a": [0, 2], "b": [-1, 1], "c": [5]}


_CELL = "CASE WHEN block IN ('B', 'A_{v}') THEN {b} ELSE {a} END"
_DRAWN = {v: _CELL.format(v=v, a=uniform_sql("id", f"'{v}'", "'A'", seed=5), b=uniform_sql("id", f"'{v}'", "'B'", seed=5)) for v in "ac"}


@query("l1_design_table", f"""WITH r AS (SELECT c_custkey AS id, unnest(['A', 'B', 'A_a', 'A_b', 'A_c']) AS block FROM customer), d AS (SELECT block, 2 * {_DRAWN['a']} AS a, CASE WHEN {_DRAWN['c']} < 0.5 THEN 0.0 ELSE 1.0 END::DOUBLE AS c FROM r)
    SELECT block, count(*) AS n, round(avg(a), 2) AS a, min(c) AS low, max(c) AS high FROM d GROUP BY 1""")
def _(v):
    return sensitivity.design_table(v.table("customer").select(F.col("c_custkey").alias("id")), _BOUNDS, seed=5, categories=["c"]).groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("a"), 2).alias("a"), F.min("c").alias("low"), F.max("c").alias("high"))


_OUT = """wd AS (SELECT l_orderkey AS id, avg(l_quantity) AS A, avg(l_discount) * 500 AS B, avg(l_quantity) + avg(l_tax) * 100 AS Ax, avg(l_discount) * 400 + count(*) AS Ay FROM lineitem GROUP BY 1), vr AS (SELECT var_pop(y) AS v FROM (SELECT A AS y FROM wd UNION ALL SELECT B FROM wd))"""


def _given(v):
    wide = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_quantity").alias("A"), (F.avg("l_discount") * 500).alias("B"), (F.avg("l_quantity") + F.avg("l_tax") * 100).alias("A_x"), (F.avg("l_discount") * 400 + F.count("*")).alias("A_y"))
    return wide.unpivot(["id"], ["A", "B", "A_x", "A_y"], "block", "y")


@query("l2_sobol_indices", f"WITH {_OUT} SELECT unnest(['x', 'y']) AS variable, unnest([round(avg(B * (Ax - A)) / any_value(v), 6), round(avg(B * (Ay - A)) / any_value(v), 6)]) AS s1, unnest([round(avg(pow(A - Ax, 2)) / 2 / any_value(v), 6), round(avg(pow(A - Ay, 2)) / 2 / any_value(v), 6)]) AS st FROM wd, vr")
def _(v):
    return rounded(sensitivity.sobol_indices(_given(v), ["x", "y"]), "s1", "st")


@query("l2_second_order", f"WITH {_OUT}, s AS (SELECT avg(B * (Ax - A)) / any_value(v) AS sx, avg(B * (Ay - A)) / any_value(v) AS sy, avg((Ax + 1) * Ay - A * B) / any_value(v) AS v2 FROM wd, vr) SELECT 'x' AS i, 'y' AS j, round(v2 - sx - sy, 6) AS s2 FROM s")
def _(v):
    out = _given(v)
    more = out.where("block = 'A_x'").select("id", F.lit("B_x").alias("block"), (F.col("y") + 1).alias("y")).union(out.where("block = 'A_y'").select("id", F.lit("B_y"), "y"))
    return rounded(sensitivity.second_order(out.union(more), ["x", "y"]), "s2")


_WEIGHT = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in sensitivity.poisson_steps())


@query("l3_index_confidence", f"""WITH {_OUT}, u AS (SELECT wd.*, rep, {uniform_sql("id", "rep", seed=6)} AS u FROM wd, range(1, 21) t(rep)), w AS (SELECT *, {_WEIGHT} AS w FROM u),
    s AS (SELECT rep, sum(w) AS n, sum(w * (A + B)) / (2 * sum(w)) AS m, sum(w * (A * A + B * B)) / (2 * sum(w)) AS q, sum(w * B * (Ax - A)) AS sx, sum(w * B * (Ay - A)) AS sy, sum(w * pow(A - Ax, 2)) / 2 AS tx, sum(w * pow(A - Ay, 2)) / 2 AS ty FROM w GROUP BY 1),
    i AS (SELECT unnest(['x', 'y']) AS variable, unnest([sx, sy]) / n / (q - m * m) AS s1, unnest([tx, ty]) / n / (q - m * m) AS st FROM s)
    SELECT variable, round(1.96 * stddev_samp(s1), 6) AS s1_conf, round(1.96 * stddev_samp(st), 6) AS st_conf FROM i GROUP BY 1""")
def _(v):
    return rounded(sensitivity.index_confidence(_given(v), ["x", "y"], 20, seed=6), "s1_conf", "st_conf")


@query("l4_s2_extremes", "SELECT k, min(s) AS s2_min, (list(i ORDER BY s, i, j))[1] AS min_i, (list(j ORDER BY s, i, j))[1] AS min_j, max(s) AS s2_max, (list(i ORDER BY s DESC, i DESC, j DESC))[1] AS max_i, (list(j ORDER BY s DESC, i DESC, j DESC))[1] AS max_j FROM (SELECT c_nationkey AS k, c_mktsegment AS i, c_custkey AS j, c_acctbal AS s FROM customer) GROUP BY 1")
def _(v):
    return sensitivity.s2_extremes(v.table("customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("i"), F.col("c_custkey").alias("j"), F.col("c_acctbal").alias("s2")), ["k"])


@query("l5_index_convergence", f"WITH {_OUT}, sz AS (SELECT CAST(unnest([n // 4, n // 2, n]) AS INT) AS size FROM (SELECT max(l_orderkey) + 1 AS n FROM lineitem)), w2 AS (SELECT * FROM wd, sz WHERE id < size), v2 AS (SELECT size, var_pop(y) AS v FROM (SELECT size, A AS y FROM w2 UNION ALL SELECT size, B FROM w2) GROUP BY 1) SELECT size, 'x' AS variable, round(avg(B * (Ax - A)) / any_value(v), 6) AS s1, round(avg(pow(A - Ax, 2)) / 2 / any_value(v), 6) AS st FROM w2 JOIN v2 USING (size) GROUP BY 1")
def _(v):
    sizes = v.table("lineitem").agg((F.max("l_orderkey") + 1).alias("n")).select(F.explode(F.expr("transform(array(n div 4, n div 2, n), s -> cast(s as int))")).alias("size"))
    return rounded(sensitivity.index_convergence(_given(v), ["x", "y"], sizes).where("variable = 'x'"), "s1", "st")


@query("m1_math_scalars", f"SELECT p_partkey, round(p_retailprice, 1) AS r, p_size * p_size AS sq, round({-0.5 * math.log(2 * math.pi)} - ln(p_size) - 0.5 * pow((p_retailprice - 1000) / p_size, 2), 6) AS lp FROM part")
def _(v):
    return v.table("part").select("p_partkey", C.round_n(F.col("p_retailprice"), 1).alias("r"), C.square(F.col("p_size")).alias("sq"), F.round(C.log_normpdf(F.col("p_retailprice"), F.lit(1000.0), F.col("p_size").cast("double")), 6).alias("lp"))


@query("m1_median_mad", "WITH m AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY 1) SELECT p_type, round(any_value(m), 6) AS median, round(quantile_cont(abs(p_retailprice - m), 0.5), 6) AS mad FROM part JOIN m USING (p_type) GROUP BY 1")
def _(v):
    p = v.table("part").select("p_type", F.lit(0).alias("bin"), F.col("p_retailprice").alias("value"))
    return T.season_profile(p, ["p_type"], "median").select("p_type", F.round("centre", 6).alias("median"), F.round("spread", 6).alias("mad"))


@query("m2_string_scalars", "SELECT p_partkey, string_split('a/b/' || p_name, '/')[-1] AS leaf, p_brand ILIKE 'BRAND#1%' AS hit FROM part")
def _(v):
    return v.table("part").select("p_partkey", C.path_leaf(F.concat(F.lit("a/b/"), "p_name")).alias("leaf"), F.col("p_brand").ilike("BRAND#1%").alias("hit"))


@query("m3_pairwise_grouper_scan", "SELECT o_orderkey, lead(o_orderkey) OVER w AS nxt, (row_number() OVER w - 1) // 3 AS grp, round(sum(o_totalprice) OVER w, 2) AS scan FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(v):
    o, key, order = v.table("orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], ["o_orderkey"]
    following = scan.pairwise(o, key, order, ["o_orderkey"], "nxt_").select("o_orderkey", F.col("nxt_o_orderkey").alias("nxt"))
    groups = scan.grouper(o, key, order, 3, "grp").select("o_orderkey", "grp")
    sums = scan.running(o, key, order, "o_totalprice").select("o_orderkey", F.round("scan", 2).alias("scan"))
    return following.join(groups, "o_orderkey").join(sums, "o_orderkey")


@query("m3_take", "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 7")
def _(v):
    return scan.take(v.table("orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 7).select("o_orderstatus", "o_orderkey")


@query("m4_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(v):
    return v.table("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("m4_rank_within", "SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INT) AS place FROM part")
def _(v):
    return graph.rank_within(v.table("part"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_type", "p_partkey", "place")


