"""Queries of statement operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from causeway.operators import statements as H
from causeway.plans.registry import query

_CNT = "SELECT subj, obj, count(*) AS n FROM evidence WHERE {} GROUP BY ALL"


def _counted(df):
    return df.groupBy("subj", "obj").agg(F.count("*").alias("n"))


@query("h1_filter_statements", _CNT.format("belief >= 0.95 AND subj_score >= 0.2 AND obj_score >= 0.2 AND subj <> obj"), "evidence")
def _(v):
    return _counted(H.filter_statements(v.evidence, 0.95, 0.2))


@query("h2_filter_statements_strict", _CNT.format("belief > 0.95 AND subj_score > 0.2 AND obj_score > 0.2"), "evidence")
def _(v):
    return _counted(H.filter_statements_strict(v.evidence, 0.95, 0.2))


@query("h3_influence_from_groundings", "SELECT subj, obj, count(*) AS n, sum(obj_pol) AS pol, count(*) FILTER (obj_adj IS NULL) AS plain FROM evidence WHERE belief >= 0.92 AND subj_score >= 0.3 AND obj_score >= 0.1 AND obj_score >= 0.3 AND subj <> obj GROUP BY ALL", "evidence")
def _(v):
    def side(s):
        refs = F.create_map(F.lit("WM"), F.to_json(F.array(F.array(F.col(s), F.col(f"{s}_score").cast("string")))), F.lit("TEXT"), F.lit("text"))
        adjectives = F.when(F.col(f"{s}_adj").isNull(), F.array().cast("array<string>")).otherwise(F.array(f"{s}_adj"))
        return F.struct(F.struct(F.col(s).alias("name"), refs.alias("db_refs")).alias("concept"), F.struct(F.col(f"{s}_pol").alias("polarity"), adjectives.alias("adjectives")).alias("delta")).alias(s)

    st = v.evidence.select(F.lit("Influence").alias("type"), F.col("stmt").alias("id"), "belief", side("subj"), side("obj"))
    out = H.influence_from_groundings(st, "WM", 0.92, 0.3)
    return out.groupBy("subj", "obj").agg(F.count("*").alias("n"), F.sum("obj_pol").alias("pol"), F.count_if(F.col("obj_adj") == "None").alias("plain"))


@query("h4_well_grounded", "SELECT p_partkey, p_partkey % 3 <> 0 AS grounded, p_partkey % 3 <> 0 AND p_size >= 20 AS well FROM part")
def _(v):
    name = F.concat(F.lit("wm/"), F.when(F.col("p_partkey") % 3 == 0, F.lit("properties")).otherwise(F.lit("concept")), F.lit("/"), F.col("p_type"))
    return v.table("part").select("p_partkey", H.is_grounded(name).alias("grounded"), H.is_well_grounded(name, F.col("p_size"), 20).alias("well"))


@query("h5_contains_concept", _CNT.format("(subj IN ('n1', 'n2') AND subj_score >= 0.5) OR (obj IN ('n1', 'n2') AND obj_score >= 0.5)"), "evidence")
def _(v):
    return _counted(H.contains_concept(v.evidence, ["n1", "n2"], 0.5))


@query("h6_top_grounding", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS top FROM part")
def _(v):
    pairs = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.col("p_type").alias("name"), F.lit(0.9).alias("score"))))
    return v.table("part").select("p_partkey", H.top_grounding(pairs, F.col("p_name")).alias("top"))


@query("h7_valid_for_modeling", _CNT.format("stmt % 4 > 0 AND stmt % 5 > 0"), "evidence")
def _(v):
    df = v.evidence.withColumns({"subj": F.when(F.col("stmt") % 4 > 0, F.col("subj")), "obj_pol": F.when(F.col("stmt") % 5 > 0, F.col("obj_pol"))})
    return _counted(H.valid_for_modeling(df))


@query("h8_prune_corpus", "SELECT replace(subj, 'n1', 'x_1') AS subj, replace(obj, 'n1', 'x_1') AS obj, count(*) AS n FROM evidence WHERE subj NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0) AND obj NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0) GROUP BY ALL", "evidence")
def _(v):
    gone = v.table("nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return _counted(H.prune_corpus(v.evidence, gone, [("n1", "x 1")]))



@query("h9_evidence_rows", "SELECT subj, obj, coalesce(subj_adj, 'None') AS subj_adj, count(*) AS n, sum(CASE WHEN evid % 2 = 0 THEN 1 ELSE subj_pol END) AS pol FROM evidence WHERE evid % 5 > 0 GROUP BY ALL", "evidence")
def _(v):
    none = F.array().cast("array<string>")
    adj = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.array(c))
    context = F.when(F.col("evid") % 5 > 0, F.struct(adj("subj_adj").alias("subj_adjectives"), F.when(F.col("evid") % 2 > 0, F.col("subj_pol")).alias("subj_polarity"), adj("obj_adj").alias("obj_adjectives"), F.col("obj_pol").alias("obj_polarity"), F.lit("t").alias("text")))
    side = lambda s: F.struct(F.col(s).alias("concept"), F.col(f"{s}_score").alias("concept_score")).alias(s)
    st = v.evidence.select(F.col("stmt").cast("string").alias("id"), "belief", side("subj"), side("obj"), F.array(F.struct(context.alias("evidence_context"))).alias("evidence"))
    return H.evidence_rows(st).groupBy("subj", "obj", "subj_adj").agg(F.count("*").alias("n"), F.sum("subj_pol").alias("pol"))


@query("h10_evidence_collection", "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS pos, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderpriority, 'None'] ELSE [o_orderpriority] END) AS adj, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [-1, 1] ELSE [1] END) AS pol FROM orders")
def _(v):
    pol = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array().cast("array<int>"))
    return H.evidence_collection(v.table("orders").select("o_orderkey", F.array("o_orderpriority").alias("adj"), pol.alias("pol")), ["adj", "pol"], ["None", 1])


@query("h11_nodes_from_evidence", "SELECT subj AS name FROM evidence UNION SELECT obj FROM evidence", "evidence")
def _(v):
    return H.nodes_from_evidence(v.evidence)


@query("h12_polarity_override", "SELECT subj, obj, sum(CASE WHEN subj = 'n1' AND obj = 'n2' THEN -1 ELSE subj_pol END) AS p, sum(CASE WHEN subj = 'n1' AND obj = 'n2' THEN 1 ELSE obj_pol END) AS q FROM evidence GROUP BY ALL", "evidence")
def _(v):
    o = v.table("nation").where("n_nationkey = 1").select(F.lit("n1").alias("subj"), F.lit("n2").alias("obj"), F.lit(-1).alias("subj_pol"), F.lit(1).alias("obj_pol"))
    return H.polarity_override(v.evidence, o).groupBy("subj", "obj").agg(F.sum("subj_pol").alias("p"), F.sum("obj_pol").alias("q"))


@query("h13_merge_nodes", "SELECT s AS subj, o AS obj, count(*) AS n, sum(sp * op) AS pol FROM (SELECT CASE subj WHEN 'n3' THEN 'n4' ELSE subj END AS s, CASE obj WHEN 'n3' THEN 'n4' ELSE obj END AS o, CASE subj WHEN 'n3' THEN -subj_pol ELSE subj_pol END AS sp, CASE obj WHEN 'n3' THEN -obj_pol ELSE obj_pol END AS op FROM evidence) WHERE s <> o GROUP BY ALL", "evidence")
def _(v):
    return H.merge_nodes(v.evidence, "n3", "n4", False).groupBy("subj", "obj").agg(F.count("*").alias("n"), F.sum(F.col("subj_pol") * F.col("obj_pol")).alias("pol"))


def _edits(v):
    n = v.table("nation")
    return n.crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("k")).where("k < 14"))).selectExpr("concat('n', n_nationkey) src", "concat('n', k) dst", "(n_nationkey * 7 + k) % 13 / 10D weight", "(n_nationkey + k) % 3 - 1 polarity")


_EDITS = """ed AS (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst, (a.n_nationkey * 7 + b.n_nationkey) % 13 / 10 AS weight, (a.n_nationkey + b.n_nationkey) % 3 - 1 AS polarity FROM nation a, nation b WHERE b.n_nationkey < 14),
    nd AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges), coded AS (SELECT ed.*, CAST(CASE WHEN ed.src NOT IN (SELECT name FROM nd) THEN 2 WHEN ed.dst NOT IN (SELECT name FROM nd) THEN 4 WHEN e.src IS NULL THEN 8 WHEN polarity = 0 THEN 0 WHEN weight >= 1 THEN 1 ELSE 0 END AS INT) AS code FROM ed LEFT JOIN edges e ON ed.src = e.src AND ed.dst = e.dst)"""


def _weighted(v):
    nodes = v.edges.select(F.col("src").alias("name")).union(v.edges.select("dst")).distinct()
    return H.edge_weight_edit(nodes, v.edges.select("src", "dst", F.lit(0.25).alias("theta"), F.lit(False).alias("frozen")), _edits(v))


@query("h14_edge_weight_codes", f"WITH {_EDITS} SELECT src, dst, code FROM coded", "edges")
def _(v):
    return _weighted(v)[1].select("src", "dst", "code")


@query("h14_edge_weight_edit", f"WITH {_EDITS} SELECT e.src, e.dst, round(CASE WHEN code = 0 AND polarity <> 0 THEN polarity * weight * {math.pi / 2} ELSE 0.25 END, 9) + 0.0 AS theta, coalesce(code = 0 AND polarity <> 0, false) AS frozen FROM edges e LEFT JOIN coded c ON e.src = c.src AND e.dst = c.dst", "edges")
def _(v):
    return _weighted(v)[0].withColumn("theta", F.round("theta", 9) + 0.0)


@query("h15_edge_weight_report", f"SELECT src, dst, round(CASE WHEN src < 'n3' THEN (SELECT avg(d.theta) FROM draws d WHERE d.src = e.src AND d.dst = e.dst) * {2 / math.pi} WHEN src = 'n5' THEN 0.5 ELSE theta * {2 / math.pi} END, 9) AS weight FROM theta e", "edges dag theta draws")
def _(v):
    e = v.theta.withColumn("frozen", ~((F.col("src") < "n3") | (F.col("src") == "n5")))
    return H.edge_weight_report(e, v.draws.where("src <> 'n5'")).withColumn("weight", F.round("weight", 9))


def _attached(v):
    return v.concept_map.select("concept", "indicator", "source").distinct().withColumn("place", F.lit(0))


@query("h16_attach_indicators", "SELECT DISTINCT p_type AS concept, p_brand AS indicator FROM part UNION ALL SELECT min(n_name), 'new' || (n_nationkey % 7) FROM nation GROUP BY n_nationkey % 7")
def _(v):
    more = v.table("nation").selectExpr("n_name concept", "concat('new', n_nationkey % 7) indicator", "'P' source", "0 place")
    used = v.concept_map.select("concept", "indicator", "source").distinct().withColumn("place", F.lit(0))
    return H.attach_indicators(used, more)[0].select("concept", "indicator")


@query("h16_replace_indicators", "SELECT DISTINCT p_type AS concept, CASE WHEN p_brand = 'Brand#1' THEN 'swapped' ELSE p_brand END AS indicator FROM part")
def _(v):
    swaps = v.concept_map.where("indicator = 'Brand#1'").select("concept", "indicator").distinct().withColumns({"new_indicator": F.lit("swapped"), "new_source": F.lit("N")})
    return H.replace_indicators(_attached(v), swaps).select("concept", "indicator")


@query("h16_delete_indicators", "SELECT DISTINCT p_type AS concept, p_brand AS indicator FROM part WHERE p_type <> (SELECT min(p_type) FROM part) AND p_brand <> 'Brand#1'")
def _(v):
    one = v.concept_map.where("indicator = 'Brand#1'").select("concept", "indicator").distinct()
    all_ = v.concept_map.agg(F.min("concept").alias("concept")).withColumn("indicator", F.lit(None).cast("string"))
    return H.delete_indicators(_attached(v), one.union(all_)).select("concept", "indicator")
