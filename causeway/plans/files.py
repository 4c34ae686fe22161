"""Queries of readers, over files that are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.registry import query
from causeway.session import shuffles_freed
from causeway.sources import readers
from causeway.sources.writers import fresh_path


def _csv(df: DataFrame, name: str, sep: str = ",", header: bool = True, by: tuple[str, ...] = ()) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).csv(path, sep=sep, header=header)
    return path


def _documents(df: DataFrame, key: str, name: str) -> str:
    """One JSON document a key, each in a file of its own: a glob of them all. A document is one row, by a bounded key."""
    path = fresh_path(df.sparkSession, name)
    columns = [c for c in df.columns if c != key]
    text = df.select(F.col(key).alias("doc"), (F.to_json(F.struct(*columns)) if columns != ["value"] else F.col("value")).alias("value"))
    text.repartition("doc").write.partitionBy("doc").text(path)
    return f"{path}/*/*"


@query("a2_read_layouts", """SELECT c_custkey AS key, c_name AS area, CASE WHEN c_custkey % 3 < 2 THEN c_acctbal END AS value, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS segment, false AS rejected FROM customer WHERE c_custkey % 7 <> 5
    UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 7 = 5""")
def _(v):
    """Three layouts with other columns in other orders, names that hold commas and quotes, and lines that are too long."""
    c = v.table("customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit('"a", '), "c_name").alias("area"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment"), F.lit("F").alias("Flag"))
    layouts = {0: ("key", "area", "Flag", "value", "segment"), 1: ("value", "area", "key"), 2: ("area", "segment", "Flag", "key")}
    paths = []
    for k, columns in layouts.items():
        path = fresh_path(v.spark, "layout")
        quoted = [F.concat(F.lit('"'), F.replace(F.col(x).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) if x == "area" else F.col(x).cast("string") for x in columns]
        lines = F.concat_ws(",", *quoted, F.when(F.col("key") % 7 == 5, F.lit("one,more")))
        rows = c.where(F.col("key") % 3 == k).select(F.lit(1).alias("place"), lines.alias("value"))
        head = v.spark.createDataFrame([(0, ",".join(columns))], "place int, value string")
        # one file with one header, as such exports come
        head.union(rows).repartition(1).sortWithinPartitions("place").select("value").write.text(path)
        paths.append(path)
    read = readers.read_layouts(v.spark, paths, encoding="UTF-8", rejects="reject")
    return read.select(F.col("key").cast("long").alias("key"), F.replace("area", F.lit('"a", '), F.lit("")).alias("area"), F.col("value").cast("double").alias("value"), "segment", F.col("reject").isNotNull().alias("rejected"))


@query("a3_read_wide_years", """SELECT n_name AS country, 'orders' AS variable, CAST(year(o_orderdate) AS INT) AS year, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_20') GROUP BY ALL""")
def _(v):
    rows = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    years = [str(y) for y in range(1990, 2003)]
    wide = rows.withColumn("y", F.year("o_orderdate").cast("string")).groupBy(F.col("n_name").alias("Country Name")).pivot("y", years).agg(F.count("o_orderkey")).withColumn("Indicator Name", F.lit("orders"))
    return readers.read_wide_years(v.spark, _csv(wide, "years"), {"Country Name": "country", "Indicator Name": "variable"}, ["NATION_1", "NATION_3", "NATION_20"])


@query("a4_read_adjectives", "SELECT p_brand AS adjective, p_retailprice AS response FROM part WHERE p_partkey % 10 <> 0")
def _(v):
    path = fresh_path(v.spark, "adjectives")
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat_ws(" ", F.lit("too short"), "p_brand")).otherwise(F.concat_ws("  ", F.lit(" 1"), F.lit("2"), "p_brand", F.lit("4"), F.lit("5"), F.lit("6"), "p_retailprice"))
    v.table("part").select(line.alias("value")).write.text(path)
    return readers.read_adjectives(v.spark, path)


@query("a5_read_concept_map", "SELECT p_type AS concept, 'P' AS source, p_brand AS indicator, p_retailprice / 1000 AS score FROM part WHERE p_partkey % 2 = 0")
def _(v):
    half = F.when(F.col("p_partkey") % 2 == 0, "P").otherwise("Q")
    df = v.table("part").select(F.concat(F.lit(" "), "p_type").alias("concept"), half.alias("source"), F.concat("p_brand", F.lit(' ""')).alias("indicator"), (F.col("p_retailprice") / 1000).alias("score"))
    return readers.read_concept_map(v.spark, _csv(df, "map", "\t", False), "P")


@query("a6_read_dssat_aggregate", """SELECT CAST(s_suppkey AS VARCHAR) AS day, CAST(s_nationkey AS VARCHAR) AS area, 'Upper ' || n_name AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'Maize' ELSE 'QQ' END AS crop, 'DSSAT' AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(v):
    place = F.concat(F.lit("Upper-"), F.replace("n_name", F.lit("_"), F.lit(".")), F.when(F.col("n_nationkey") % 2 == 0, "_MZ").otherwise("_QQ"))
    df = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("day"), F.col("s_nationkey").alias("area"), place.alias("place"))
    name = F.regexp_extract(F.col("_metadata.file_path"), "place=([^/]*)/", 1)
    read = readers.read_dssat_aggregate(v.spark, _csv(df, "dssat", by=("place",)), ["day", "area"], {"MZ": "Maize"}, name)
    return read.withColumn("state", F.replace("state", F.lit("."), F.lit("_")))


@query("a7_columns_from_filename", "SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def _(v):
    o = v.table("orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    path = _csv(o, "named", by=("status", "year"))
    read = v.spark.read.option("recursiveFileLookup", True).csv(path, schema="o_orderkey long, o_totalprice double", header=True)
    named = readers.columns_from_filename(F.col("_metadata.file_path"), {"status": r"status=(\w)/", "year": r"year=(\d{4})/"})
    return read.select("o_totalprice", *[c.alias(k) for k, c in named.items()]).groupBy("status", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _side(concept, score, polarity, adjective):
    return F.struct(concept.alias("concept"), score.alias("concept_score"), polarity.alias("polarity"), F.array(adjective).alias("adjectives"), F.lit("t").alias("theme"))


def _statement(e: DataFrame) -> DataFrame:
    """stmt and s, a statement with one piece of evidence, of each row of the evidence view."""
    noted = F.struct(F.array("subj_adj").alias("subj_adjectives"), F.col("subj_pol").alias("subj_polarity"), F.array("obj_adj").alias("obj_adjectives"), F.col("obj_pol").alias("obj_polarity"), F.lit("x").alias("text"))
    s = F.struct(F.concat_ws(":", "stmt", "evid").alias("id"), "belief", _side(F.col("subj"), F.col("subj_score"), F.col("subj_pol"), F.col("subj_adj")).alias("subj"), _side(F.col("obj"), F.col("obj_score"), F.col("obj_pol"), F.col("obj_adj")).alias("obj"), F.array(F.struct(noted.alias("evidence_context"))).alias("evidence"))
    return e.select("stmt", "evid", "subj", s.alias("s"))


@query("a8_read_statements_jsonl", "SELECT stmt || ':' || evid AS id, subj, obj, round(belief, 6) AS belief, coalesce(subj_adj, 'None') AS subj_adj, obj_pol FROM evidence", "evidence")
def _(v):
    path = fresh_path(v.spark, "statements")
    lines = _statement(v.evidence).select(F.to_json(F.struct(F.col("s").alias("_source"))).alias("value"))
    with shuffles_freed(v.spark):
        lines.union(v.spark.createDataFrame([("{}",), ("not JSON",)], "value string")).write.option("compression", "gzip").text(path)
    st = readers.read_statements_jsonl(v.spark, path)
    return st.select("id", F.col("subj.concept").alias("subj"), F.col("obj.concept").alias("obj"), F.round("belief", 6).alias("belief"), F.coalesce(F.col("evidence")[0]["evidence_context"]["subj_adjectives"][0], F.lit("None")).alias("subj_adj"), F.col("evidence")[0]["evidence_context"]["obj_polarity"].alias("obj_pol"))


def _extracted(v) -> str:
    """Suppliers as extracted statements, a document for each nation (those of a nation in one array)."""
    agent = lambda name, score, text: F.struct(F.struct(name.alias("name"), F.create_map(F.lit("TEXT"), text, F.lit("UN"), F.to_json(F.array(F.array(F.concat(F.lit("UN/"), name), score.cast("string"))))).alias("db_refs")).alias("concept"), F.struct(F.lit(-1).alias("polarity"), F.array(F.lit("large")).alias("adjectives")).alias("delta"))
    s = v.table("supplier")
    kind = F.when(F.col("s_suppkey") % 4 == 3, "Association").otherwise("Influence")
    one = F.struct(kind.alias("type"), F.lit(0.5).alias("belief"), F.col("s_suppkey").cast("string").alias("id"), agent(F.col("s_name"), F.lit(0.75), F.lit("the supplier")).alias("subj"), agent(F.concat(F.lit("n"), "s_nationkey"), F.lit(0.25), F.lit("the nation")).alias("obj"))
    return _documents(s.groupBy("s_nationkey").agg(F.to_json(F.collect_list(one)).alias("value")), "s_nationkey", "extracted")


@query("a9_read_statements_json", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS subj, 'n' || s_nationkey AS obj, 0.5::DOUBLE AS belief FROM supplier WHERE s_suppkey % 4 <> 3")
def _(v):
    return readers.read_statements_json(v.spark, _extracted(v)).select("id", F.col("subj.concept.name").alias("subj"), F.col("obj.concept.name").alias("obj"), "belief")


@query("a10_read_create_model", """SELECT 'm' || c_nationkey AS model, 'b' || c_mktsegment AS concept, 'i' || c_mktsegment AS indicator, CAST(c_custkey AS BIGINT) AS ts_ms, c_acctbal AS value, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS statements FROM customer""")
def _(v):
    """A model document for each nation: statements of its suppliers, and series of its customers by segment."""
    values = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("timestamp"), F.col("c_acctbal").alias("value")))).alias("values")
    series = v.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(values).select("c_nationkey", F.concat(F.lit("b"), "c_mktsegment").alias("k"), F.struct(F.concat(F.lit("i"), "c_mktsegment").alias("name"), F.lit("F").alias("source"), F.lit("mean").alias("func"), "values").alias("s"))
    series = series.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("conceptIndicators"))
    found = v.table("supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.lit(0.5).alias("belief"))).alias("statements"))
    docs = series.join(found, F.col("c_nationkey") == F.col("s_nationkey"), "left").select(F.col("c_nationkey").alias("n"), F.concat(F.lit("m"), "c_nationkey").alias("id"), "statements", "conceptIndicators")
    st, obs = readers.read_create_model(v.spark, _documents(docs, "n", "models"))
    counts = st.groupBy("model").agg(F.count("*").alias("statements"))
    return obs.select("model", "concept", "indicator", "ts_ms", "value").join(counts, "model", "left").withColumn("statements", F.coalesce("statements", F.lit(0)).cast("long"))


@query("a11_read_constraints", """SELECT 'n' || n_nationkey AS concept, CAST(s_suppkey AS INT) AS step, s_acctbal AS value, CASE n_nationkey % 2 WHEN 0 THEN 4 ELSE 5 END AS steps FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0""")
def _(v):
    """An experiment for each nation, in both spellings of the parameters; every fifth step is null."""
    step = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey"))
    n = v.table("supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(step.alias("step"), F.col("s_acctbal").alias("value"))).alias("values"))
    inner = F.array(F.struct(F.concat(F.lit("n"), "s_nationkey").alias("concept"), "values")).alias("constraints")
    even = F.col("s_nationkey") % 2 == 0
    body = F.when(even, F.to_json(F.struct(F.struct(F.lit(1).alias("startTime"), F.lit(2).alias("endTime"), F.lit(4).alias("numTimesteps"), inner).alias("experimentParam")))).otherwise(F.to_json(F.struct(F.struct(F.lit(1).alias("startTime"), F.lit(2).alias("endTime"), F.lit(5).alias("numTimeSteps"), inner).alias("experimentParams"))))
    params, found = readers.read_constraints(v.spark, _documents(n.select("s_nationkey", body.alias("value")), "s_nationkey", "experiments"))
    steps = params.groupBy("steps").agg(F.count("*").alias("docs")).select("steps")
    return found.withColumn("steps", F.when(F.substring("concept", 2, 9).cast("int") % 2 == 0, 4).otherwise(5)).join(steps, "steps").select("concept", "step", "value", "steps")


@query("a12_read_groundings", """SELECT s_name AS name, 'the supplier' AS text, 'UN/' || s_name AS grounding, 0.75::DOUBLE AS score FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT 'n' || s_nationkey, 'the nation', 'UN/n' || s_nationkey, 0.25 FROM supplier WHERE s_suppkey % 4 <> 3""")
def _(v):
    return readers.read_groundings(v.spark, _extracted(v), "UN").select("name", "text", F.col("groundings")[0]["name"].alias("grounding"), F.col("groundings")[0]["score"].alias("score"))


@query("a13_read_timings", "SELECT CAST(o_orderkey AS INT) AS run, nodes, edges, wall, cpu FROM (SELECT o_orderkey, CAST(o_custkey % 8 AS INT) AS nodes, CAST(o_orderkey % 4 AS INT) AS edges, o_custkey * 1.5::DOUBLE AS wall, o_orderkey * 0.5::DOUBLE AS cpu FROM orders)")
def _(v):
    rows = v.table("orders").selectExpr("o_orderkey run", "o_custkey % 8 nodes", "o_orderkey % 4 edges", "10 kernels", "o_custkey * 1500000 wall_ns", "o_orderkey * 500000 cpu_ns", "0 kind")
    path = _csv(rows, "timings")
    rows.select(F.lit("not,timings").alias("value")).limit(3).write.mode("append").text(path)  # *.txt, which the filter leaves out
    return readers.read_timings(v.spark, path, "*.csv").select("run", "nodes", "edges", "wall", "cpu")


@query("a14_read_links", """SELECT 'variable::s::' || s_name AS id_1, 'variable' AS type_1, 'comment::s::n' || s_nationkey AS id_2, 'comment' AS type_2, s_suppkey / 8.0::DOUBLE AS score FROM supplier""")
def _(v):
    end = lambda kind, content: F.struct(F.lit(kind).alias("type"), F.lit("s").alias("source"), content.alias("content"))
    one = F.struct(end("variable", F.col("s_name")).alias("element_1"), end("comment", F.concat(F.lit("n"), "s_nationkey")).alias("element_2"), (F.col("s_suppkey") / 8).alias("score"))
    return readers.read_links(v.spark, _documents(v.table("supplier").groupBy("s_nationkey").agg(F.collect_list(one).alias("grounding")), "s_nationkey", "links"))
