"""Queries of seasonal fitting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from causeway.operators import seasonal as G
from causeway.operators import timeseries as T
from causeway.plans.registry import query
from causeway.plans.series import rounded


def _binned(v):
    return T.season_bin(v.means, 12).select("concept", "step", "bin", "value")


@query("g1_fourier_features", f"SELECT DISTINCT CAST(step % 12 AS INT) AS bin, 1.0::DOUBLE AS x0, round(sin(step % 12 * {math.pi / 6}), 9) AS x1, round(cos(step % 12 * {math.pi / 6}) * {math.pi / 6}, 9) AS x2, round(sin(step % 12 * {math.pi / 3}), 9) AS x3, round(cos(step % 12 * {math.pi / 3}) * {math.pi / 3}, 9) AS x4 FROM means", "steps means")
def _(v):
    # + 0.0 turns the negative zero of rounding into zero
    x = G.fourier_features(_binned(v).select("bin").distinct(), 12, 2)
    return x.select("bin", "x0", *[(F.round(f"x{i}", 9) + 0.0).alias(f"x{i}") for i in range(1, 5)])


_XY = f"x AS (SELECT concept, step % 12 AS b, sin(step % 12 * {math.pi / 6}) AS s, cos(step % 12 * {math.pi / 6}) AS c, value AS y FROM means)"


@query("g2_fourier_fit", f"""WITH {_XY}, m AS (SELECT concept, count(*) AS n, avg(s) AS ms, avg(c) AS mc, avg(y) AS my, covar_pop(s, s) AS ss, covar_pop(c, c) AS cc, covar_pop(s, c) AS sc, covar_pop(s, y) AS sy, covar_pop(c, y) AS cy FROM x GROUP BY 1),
    f AS (SELECT *, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS bs, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS bc FROM m) SELECT concept, round(my - bs * ms - bc * mc, 2) AS c0, round(bs, 2) AS c1, round(bc / {math.pi / 6}, 2) AS c2 FROM f""", "steps means")
def _(v):
    fit = G.fourier_fit(_binned(v), ["concept"], 12, 1)
    return fit.select("concept", *[F.round(F.get("coef", F.lit(i)), 2).alias(f"c{i}") for i in range(3)])


@query("g3_fourier_predict", """WITH p AS (SELECT concept, step % 12 AS b, avg(value) AS a FROM means GROUP BY ALL), m AS (SELECT concept, avg(value) AS mean FROM means GROUP BY 1) SELECT DISTINCT concept, step, round(mean, 3) AS predicted FROM means JOIN m USING (concept)""", "steps means")
def _(v):
    fit = G.fourier_fit(_binned(v), ["concept"], 12, 0)
    return rounded(G.fourier_predict(fit, _binned(v).select("concept", "step", "bin"), ["concept"], 12, 0), "predicted", digits=3).select("concept", "step", "predicted")


@query("g4_bin_rmse", "WITH m AS (SELECT concept, avg(value) AS mean FROM means GROUP BY 1) SELECT concept, CAST(step % 12 AS INT) AS bin, round(sqrt(avg(pow(mean - value, 2))), 3) AS rmse FROM means JOIN m USING (concept) GROUP BY ALL", "steps means")
def _(v):
    fit = G.fourier_fit(_binned(v), ["concept"], 12, 0)
    return rounded(G.bin_rmse(G.fourier_predict(fit, _binned(v), ["concept"], 12, 0), ["concept"])[0], "rmse", digits=3)


@query("g4_combined_rmse", "WITH m AS (SELECT concept, avg(value) AS mean FROM means GROUP BY 1) SELECT concept, round(sqrt(avg(pow(mean - value, 2))), 3) AS rmse FROM means JOIN m USING (concept) GROUP BY ALL", "steps means")
def _(v):
    fit = G.fourier_fit(_binned(v), ["concept"], 12, 0)
    return rounded(G.bin_rmse(G.fourier_predict(fit, _binned(v), ["concept"], 12, 0), ["concept"])[1], "rmse", digits=3)


@query("g5_select_components", """WITH e AS (SELECT o_custkey AS k0, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k, o_totalprice AS rmse FROM orders), f AS (SELECT *, coalesce(rmse < lag(rmse) OVER w, k = 0) AS falls FROM e WINDOW w AS (PARTITION BY k0 ORDER BY k)),
    g AS (SELECT *, bool_and(falls) OVER (PARTITION BY k0 ORDER BY k) AS go FROM f) SELECT k0, max(k) FILTER (go) AS k FROM g GROUP BY 1""")
def _(v):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return G.select_components(v.table("orders").select(F.col("o_custkey").alias("k0"), k.alias("k"), F.col("o_totalprice").alias("rmse")), ["k0"])


@query("g5_fit_all")
def _(v):
    mids = T.midpoints(v.means, ["concept"], 12)
    return rounded(G.fit_all(_binned(v), mids, ["concept"], 12, 6), "rmse", digits=3)


@query("g6_naive_baseline", """WITH t AS (SELECT concept, step % 12 AS b, avg(value) AS p FROM means WHERE step < 96 GROUP BY ALL) SELECT concept, round(sqrt(avg(pow(p - value, 2))), 3) AS rmse FROM means JOIN t USING (concept) WHERE step % 12 = b AND step >= 96 GROUP BY 1""", "steps means")
def _(v):
    b = _binned(v)
    return rounded(G.naive_baseline(b.where("step < 96"), b.where("step >= 96"), ["concept"]), "rmse", digits=3)
