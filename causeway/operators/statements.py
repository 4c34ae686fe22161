"""Causal statements to evidence, edges and their edits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.clean import rename_groundings
from causeway.sources.readers import groundings


def filter_statements(evidence: DataFrame, belief: float = 0.0, grounding: float = 0.0) -> DataFrame:
    """Without rows that lack a belief, concept or score, fall below a cutoff, or relate a concept to itself."""
    return evidence.where((F.col("belief") >= belief) & (F.col("subj_score") >= grounding) & (F.col("obj_score") >= grounding) & (F.col("subj") != F.col("obj")))


def filter_statements_strict(evidence: DataFrame, belief: float, grounding: float) -> DataFrame:
    """Strictly above the cutoffs; a missing polarity counts as 1."""
    kept = evidence.where((F.col("belief") > belief) & (F.col("subj_score") > grounding) & (F.col("obj_score") > grounding))
    return kept.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("subj_pol", "obj_pol")})


def influence_from_groundings(statements: DataFrame, ontology: str, belief: float = 0.0, grounding: float = 0.0) -> DataFrame:
    """Extracted statements as evidence rows by each side's top grounding in one ontology; each side
    keeps its own adjective."""

    def side(s: str) -> dict[str, Column]:
        top = F.get(groundings(F.col(f"{s}.concept.db_refs"), ontology), F.lit(0))
        return {s + "_name": top["name"], f"{s}_score": top["score"], f"{s}_pol": F.coalesce(f"{s}.delta.polarity", F.lit(1)), f"{s}_adj": F.coalesce(F.get(f"{s}.delta.adjectives", F.lit(0)), F.lit("None"))}

    rows = statements.where("type = 'Influence'").select("id", "belief", *[c.alias(k) for s in ("subj", "obj") for k, c in side(s).items()])
    rows = rows.withColumnsRenamed({"subj_name": "subj", "obj_name": "obj"})
    return filter_statements(rows, belief, grounding)


def is_grounded(name: Column) -> Column:
    """Whether a grounding is there and its second path part isn't 'properties'."""
    return name.isNotNull() & (F.coalesce(F.get(F.split(name, "/"), F.lit(1)), F.lit("")) != "properties")


def is_well_grounded(name: Column, score: Column, cutoff: float) -> Column:
    return is_grounded(name) & F.coalesce(score >= cutoff, F.lit(False))


def contains_concept(evidence: DataFrame, names: Sequence[str], cutoff: float) -> DataFrame:
    """Rows of which either side is well grounded to one of the names."""
    sides = [F.col(s).isin(*names) & is_well_grounded(F.col(s), F.col(f"{s}_score"), cutoff) for s in ("subj", "obj")]
    return evidence.where(sides[0] | sides[1])


def top_grounding(pairs: Column, name: Column) -> Column:
    """The first grounding's name, or the concept's own."""
    return F.coalesce(F.get(pairs, F.lit(0))["name"], name)


def valid_for_modeling(evidence: DataFrame) -> DataFrame:
    """Both sides grounded, both polarities known."""
    return evidence.where(is_grounded(F.col("subj")) & is_grounded(F.col("obj")) & F.col("subj_pol").isNotNull() & F.col("obj_pol").isNotNull())


def prune_corpus(evidence: DataFrame, exclude: DataFrame, rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Without rows of which a side is in exclude(name); names rewritten by rules."""
    kept = evidence.join(exclude.select(F.col("name").alias("subj")), "subj", "left_anti").join(exclude.select(F.col("name").alias("obj")), "obj", "left_anti")
    for s in ("subj", "obj"):
        kept = rename_groundings(kept, s, rules)
    return kept.select(*evidence.columns)


def evidence_rows(statements: DataFrame) -> DataFrame:
    """A row for each piece of evidence with a context: polarity 1 and adjective 'None' where missing."""
    each = statements.select("id", "belief", "subj", "obj", F.posexplode("evidence").alias("evid", "e")).where("e.evidence_context IS NOT NULL")

    def of(s: str) -> list[Column]:
        c = f"e.evidence_context.{s}"
        return [F.coalesce(F.get(f"{c}_adjectives", F.lit(0)), F.lit("None")).alias(f"{s}_adj"), F.coalesce(f"{c}_polarity", F.lit(1)).alias(f"{s}_pol")]

    return each.select(F.col("id").alias("stmt"), "evid", F.col("subj.concept").alias("subj"), F.col("obj.concept").alias("obj"), "belief", F.col("subj.concept_score").alias("subj_score"), F.col("obj.concept_score").alias("obj_score"), *of("subj"), *of("obj"), F.col("e.evidence_context.text").alias("text"))


def evidence_collection(df: DataFrame, arrays: Sequence[str], defaults: Sequence) -> DataFrame:
    """Parallel arrays as rows (pos and a column for each), the shorter ones padded."""
    others = [c for c in df.columns if c not in arrays]
    rows = df.select(*others, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "__z"))
    return rows.select(*others, "pos", *[F.coalesce(F.col(f"__z.{a}"), F.lit(d)).alias(a) for a, d in zip(arrays, defaults, strict=True)])


def nodes_from_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("subj").alias("name")).union(evidence.select("obj")).distinct()


def polarity_override(evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Polarities of listed edges (subj, obj, subj_pol, obj_pol) in all of their evidence."""
    o = overrides.select("subj", "obj", F.col("subj_pol").alias("__p"), F.col("obj_pol").alias("__q"))
    return evidence.join(o, ["subj", "obj"], "left").withColumns({"subj_pol": F.coalesce("__p", "subj_pol"), "obj_pol": F.coalesce("__q", "obj_pol")}).select(*evidence.columns)


def merge_nodes(evidence: DataFrame, a: str, b: str, same_polarity: bool = True) -> DataFrame:
    """Evidence of a moved to b, with the moved side's polarity flipped unless the same; no self loops."""
    flip = 1 if same_polarity else -1
    moved = {f"{s}_pol": F.when(F.col(s) == a, flip * F.col(f"{s}_pol")).otherwise(F.col(f"{s}_pol")) for s in ("subj", "obj")}
    out = evidence.withColumns(moved).withColumns({s: F.when(F.col(s) == a, b).otherwise(F.col(s)) for s in ("subj", "obj")})
    return out.where("subj <> obj")


def edge_weight_edit(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with theta and frozen after a table of edits, and each edit's code.

    edits: src, dst, weight in [0, 1), polarity; 0 unfreezes. Codes: 0 done, 1 bad weight, 2 no
    such source, 4 no such target, 8 no such edge. edges: src, dst, theta, frozen; edits name an edge once.
    """
    s, d = nodes.select(F.col("name").alias("src"), F.lit(True).alias("__s")), nodes.select(F.col("name").alias("dst"), F.lit(True).alias("__d"))
    e = edges.select("src", "dst", F.lit(True).alias("__e"))
    told = edits.join(s, "src", "left").join(d, "dst", "left").join(e, ["src", "dst"], "left")
    code = F.when(F.col("__s").isNull(), 2).when(F.col("__d").isNull(), 4).when(F.col("__e").isNull(), 8).when(F.col("polarity") == 0, 0).when(~F.col("weight").between(0, 1) | (F.col("weight") >= 1), 1).otherwise(0)
    coded = told.select("src", "dst", "weight", "polarity", code.alias("code"))
    done = coded.where("code = 0").select("src", "dst", F.when(F.col("polarity") != 0, F.sign("polarity") * F.col("weight") * (math.pi / 2)).alias("__theta"), (F.col("polarity") != 0).alias("__frozen"))
    out = edges.join(done, ["src", "dst"], "left").select("src", "dst", F.coalesce("__theta", "theta").alias("theta"), F.coalesce("__frozen", "frozen").alias("frozen"))
    return out, coded


def edge_weight_report(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """weight of each edge, 2 theta / pi: the frozen theta's, else the mean of sampled ones', else 0.5."""
    mean = samples.groupBy("src", "dst").agg(F.avg("theta").alias("__mean"))
    theta = F.when(F.col("frozen"), F.col("theta")).otherwise(F.col("__mean"))
    return edges.join(mean, ["src", "dst"], "left").select("src", "dst", F.coalesce(theta * (2 / math.pi), F.lit(0.5)).alias("weight"))


def attach_indicators(current: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """current and additions (concept, indicator, source, place), and the additions refused because the
    indicator is in use; of several additions of one indicator the first place counts."""
    first = F.row_number().over(Window.partitionBy("indicator").orderBy("place", "concept"))
    ranked = additions.withColumn("__n", first).join(current.select("indicator", F.lit(True).alias("__used")).distinct(), "indicator", "left")
    fine = (F.col("__n") == 1) & F.col("__used").isNull()
    return current.unionByName(ranked.where(fine).select(*current.columns)), ranked.where(~fine).select(*current.columns)


def replace_indicators(current: DataFrame, swaps: DataFrame) -> DataFrame:
    """Indicators exchanged in place; swaps: concept, indicator, new_indicator, new_source."""
    joined = current.join(swaps, ["concept", "indicator"], "left")
    return joined.select("concept", F.coalesce("new_indicator", "indicator").alias("indicator"), F.coalesce("new_source", "source").alias("source"), "place").select(*current.columns)


def delete_indicators(current: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the listed (concept, indicator) pairs; a null indicator deletes all of a concept's."""
    named = current.join(gone.where("indicator IS NOT NULL").select("concept", "indicator"), ["concept", "indicator"], "left_anti")
    return named.join(gone.where("indicator IS NULL").select("concept"), "concept", "left_anti").select(*current.columns)
