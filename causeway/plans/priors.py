"""Queries of edge priors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from causeway.operators import priors as J
from causeway.plans.registry import normal_sql, query, uniform_sql
from causeway.sources.writers import write_table

_PAIR = "pr AS (SELECT stmt, evid, subj, obj, subj_pol, obj_pol, subj_score - 0.5 AS x, obj_score - 0.3 AS y FROM evidence)"
_THETA = _PAIR + ", th AS (SELECT *, CASE WHEN x * subj_pol = 0 THEN CASE WHEN y = 0 THEN 0 ELSE sign(y * obj_pol) * pi() / 2 END ELSE atan((y * obj_pol) / (x * subj_pol)) END AS theta FROM pr)"


def _theta(v):
    pairs = v.evidence.selectExpr("stmt", "evid", "subj", "obj", "subj_pol", "obj_pol", "subj_score - 0.5D x", "obj_score - 0.3D y")
    return J.theta_samples(pairs)


_POINTS = "pt AS (SELECT *, row_number() OVER (PARTITION BY adjective ORDER BY response) - 1 AS rank, count(*) OVER (PARTITION BY adjective) AS n FROM responses)"


@query("j1_smooth_resample", f"""WITH {_POINTS}, bw AS (SELECT adjective, count(*) AS n, pow(4 * pow(stddev_samp(response), 5) / (3 * count(*)), 0.2) AS bw FROM responses GROUP BY 1),
    k AS (SELECT adjective, bw, CAST(k AS INT) AS k, CAST(floor({uniform_sql("adjective", "k", seed=3)} * n) AS BIGINT) AS rank FROM bw, range(1, 51) t(k))
    SELECT adjective, k, round(response + bw * {normal_sql("adjective", "k", seed=4)}, 6) AS response FROM k JOIN pt USING (adjective, rank)""", "responses")
def _(v):
    return J.smooth_resample(v.responses, 50, None, seed=1).withColumn("response", F.round("response", 6))


@query("j1_silverman", "SELECT adjective, round(pow(4 * pow(stddev_samp(response), 5) / (3 * count(*)), 0.2), 6) AS bw FROM responses GROUP BY 1", "responses")
def _(v):
    return J.silverman(v.responses, ["adjective"]).withColumn("bw", F.round("bw", 6))


@query("j2_theta_samples", f"WITH {_THETA} SELECT stmt, evid, round(theta, 6) + 0.0 AS theta FROM th", "evidence")
def _(v):
    return _theta(v).select("stmt", "evid", (F.round("theta", 6) + 0.0).alias("theta"))


_BIN = f"CAST(greatest(0, least(19, floor((theta + {math.pi / 2}) / {math.pi / 20}))) AS INT)"
_FULL = f"{_THETA}, c AS (SELECT subj, obj, {_BIN} AS bin, count(*) AS c FROM th GROUP BY ALL), n AS (SELECT subj, obj, sum(c) AS n FROM c GROUP BY ALL), g AS (SELECT subj, obj, n, CAST(b AS INT) AS bin FROM n, range(0, 20) t(b)), p AS (SELECT g.subj, g.obj, g.bin, ln((coalesce(c, 0) + 1e-5) / (n + 1e-5 * 20)) AS lp FROM g LEFT JOIN c ON g.subj = c.subj AND g.obj = c.obj AND g.bin = c.bin)"


@query("j3_theta_log_prior", f"WITH {_FULL} SELECT subj, obj, bin, round(lp, 6) AS log_prior FROM p", "evidence")
def _(v):
    return J.theta_log_prior(_theta(v), ["subj", "obj"], 20).withColumn("log_prior", F.round("log_prior", 6))


@query("j4_theta_mode", f"WITH {_FULL} SELECT subj, obj, round(CAST({-math.pi / 2} + ((list(bin ORDER BY lp DESC, bin))[1] + 0.5) * {math.pi / 20} AS DOUBLE), 6) AS mode FROM p GROUP BY ALL", "evidence")
def _(v):
    key = ["subj", "obj"]
    return J.theta_mode(J.theta_log_prior(_theta(v), key, 20), key, 20).withColumn("mode", F.round("mode", 6))


for _m, _e in {"one": "atan(1)", "mean": "avg(theta)", "median": "quantile_cont(theta, 0.5)"}.items():

    @query(f"j5_theta_init_{_m}", f"WITH {_THETA} SELECT subj, obj, round({_e}, 6) + 0.0 AS theta FROM th GROUP BY ALL", "evidence")
    def _(v, method=_m):
        return J.theta_init(_theta(v), ["subj", "obj"], method).withColumn("theta", F.round("theta", 6) + 0.0)


@query("j6_wrap_theta", f"""SELECT o_orderkey, round(CASE WHEN abs(t) > {1.5 * math.pi} THEN NULL WHEN t > {math.pi / 2} THEN t - {math.pi} WHEN t <= {-math.pi / 2} THEN t + {math.pi} ELSE t END, 6) AS theta, abs(t) > {1.5 * math.pi} AS out FROM (SELECT o_orderkey, CAST(o_orderkey % 113 - 56 AS DOUBLE) / 10 AS t FROM orders)""")
def _(v):
    return J.wrapped(v.table("orders").select("o_orderkey", ((F.col("o_orderkey") % 113 - 56).cast("double") / 10).alias("theta"))).withColumn("theta", F.round("theta", 6))


@query("j7_theta_log_density", f"WITH {_FULL} SELECT th.stmt, th.evid, round(p.lp, 6) AS log_prior FROM th JOIN p ON th.subj = p.subj AND th.obj = p.obj AND p.bin = {_BIN}", "evidence")
def _(v):
    key, theta = ["subj", "obj"], _theta(v)
    return J.theta_log_density(theta, J.theta_log_prior(theta, key, 20), key, 20).select("stmt", "evid", F.round("log_prior", 6).alias("log_prior"))


_UP = "up AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey)"
_DRAWN = f"""{_THETA}, {_UP}, sm AS (SELECT subj AS src, obj AS dst, theta FROM th JOIN up ON subj = 'n' || i AND obj = 'n' || j), pt AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY theta) - 1 AS rank FROM sm),
    k AS (SELECT src, dst, CAST(k AS INT) AS draw, CAST(floor({uniform_sql("src", "dst", "k", seed=6)} * n) AS BIGINT) AS rank FROM (SELECT src, dst, count(*) AS n FROM sm GROUP BY ALL), range(1, 21) t(k)), d AS (SELECT draw, src, dst, theta FROM k JOIN pt USING (src, dst, rank)),
    w AS (SELECT draw, src, dst, tan(theta) AS p FROM d UNION ALL SELECT w.draw, w.src, d.dst, w.p * tan(d.theta) FROM w JOIN d ON d.draw = w.draw AND d.src = w.dst)"""


def _prior_draws(v):
    """Draws of the edges that lead from a nation to one of a later region: their graph has no cycle."""
    place = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), "n_regionkey")
    both = _theta(v).select(F.col("subj").alias("src"), F.col("obj").alias("dst"), "theta").join(place.toDF("src", "__a"), "src").join(place.toDF("dst", "__b"), "dst")
    return J.prior_draws(both.where("__a < __b").select("src", "dst", "theta"), ["src", "dst"], 20, seed=2)


@query("j8_prior_draws", f"WITH RECURSIVE {_DRAWN} SELECT draw, src, dst, round(sum(p) / greatest(1, sum(abs(p))), 6) + 0.0 AS value FROM w GROUP BY ALL", "evidence")
def _(v):
    from causeway.operators import graph

    draws = write_table(_prior_draws(v), "draws")
    # in units of the sum of its paths' sizes, since slopes may be as steep as 1e16
    sizes = graph.cell_values(draws.withColumn("theta", F.abs("theta"))).withColumnRenamed("value", "size")
    cells = graph.cell_values(draws).join(sizes, ["draw", "src", "dst"])
    return cells.select("draw", "src", "dst", (F.round(F.col("value") / F.greatest(F.lit(1.0), F.col("size")), 6) + 0.0).alias("value"))
