"""Queries of cleaning, reshaping and set operators, and of readers and writers over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway import functions as C
from causeway.operators import clean
from causeway.plans.registry import query
from causeway.sources import readers, writers


@query("a1_indicator_sentinels", "SELECT country, coalesce(county, 'None') AS county, state, coalesce(year, -1) AS year, coalesce(month, 0) AS month, count(*) AS n FROM indicator GROUP BY ALL", "indicator")
def _(v):
    return readers.fill_sentinels(v.indicator).groupBy("country", "county", "state", "year", "month").agg(F.count("*").alias("n"))


@query("a15_write_table", "SELECT variable, unit, count(*) AS n FROM indicator GROUP BY ALL", "indicator")
def _(v):
    return writers.write_table(v.indicator.groupBy("variable", "unit").agg(F.count("*").alias("n")), "indicator_counts")


@query("a16_write_tsv", "SELECT country, variable, CAST(sum(value) AS DOUBLE) AS value FROM indicator GROUP BY ALL", "indicator")
def _(v):
    df = v.indicator.groupBy("country", "variable").agg(F.sum("value").alias("value"))
    return writers.write_tsv(df, "indicator_tsv")


@query("a17_upsert", "SELECT o_custkey AS k, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN max(o_totalprice) FILTER (o_orderkey % 2 = 0) ELSE max(o_totalprice) END AS v FROM orders GROUP BY 1")
def _(v):
    o = v.table("orders")
    base = o.where("o_orderkey % 2 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    path = writers.fresh_path(v.spark, "versioned")
    writers.publish(base, path)
    return writers.upsert_into(path, new, ["k"])


@query("a18_variable_list", "SELECT DISTINCT p_type AS variable FROM part")
def _(v):
    return writers.write_variable_list(v.table("part").select(F.col("p_type").alias("variable")), "variables").withColumnRenamed("value", "variable")


@query("a19_edges_json", """WITH r AS (SELECT dst, src, count(*) OVER (PARTITION BY src) AS n, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 8 AS part FROM edges) SELECT src, n, part, string_agg(dst, ',' ORDER BY dst) AS targets FROM r GROUP BY ALL""", "edges")
def _(v):
    parsed = F.from_json("edges", "array<struct<dst:string>>")
    docs = writers.edges_json(v.edges, ["src"], ["dst"], size=8)  # many edges lead away from a nation or segment
    return docs.select("src", "n", "part", F.array_join(F.transform(parsed, lambda e: e["dst"]), ",").alias("targets"))


@query("a20_export_state", "SELECT concept, indicator, count(*) AS n, round(avg(value), 6) AS mean FROM steps GROUP BY ALL", "steps")
def _(v):
    return writers.export_state({"data": v.steps.groupBy("concept", "indicator").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))}, "state")["data"]


@query("b1_normalize_strings", "SELECT trim('  ' || p_name || ' ') AS variable, count(*) AS n FROM part GROUP BY 1")
def _(v):
    return clean.normalize_strings(v.table("part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("variable")), "variable").groupBy("variable").agg(F.count("*").alias("n"))


@query("b2_parse_number", "SELECT o_orderkey AS k, CAST(o_orderkey * 1000 + 7 AS DOUBLE) AS value FROM orders WHERE o_orderkey % 5 <> 0")
def _(v):
    text = F.when(F.col("o_orderkey") % 5 != 0, F.format_number(F.col("o_orderkey") * 1000 + 7, 0)).otherwise("n/a")
    return clean.parse_numbers(v.table("orders").select(F.col("o_orderkey").alias("k"), text.alias("value")), "value")


@query("b3_percent_or_range", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1.0 ELSE CAST(p_size AS DOUBLE) END AS value FROM part")
def _(v):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("-", "p_size", F.col("p_size") + 2)).when(F.col("p_partkey") % 3 == 1, F.concat("p_size", F.lit("%"))).otherwise(F.col("p_size").cast("string"))
    return v.table("part").select(F.col("p_partkey").alias("k"), C.percent_or_range(text).alias("value"))


@query("b4_bracketed_number", "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS value FROM part")
def _(v):
    text = F.when(F.col("p_partkey") % 7 > 0, F.concat("p_size", F.lit(" ["), F.col("p_size") - 1, F.lit("-"), F.col("p_size") + 1, F.lit("]"))).otherwise("No data")
    return v.table("part").select(F.col("p_partkey").alias("k"), C.bracketed_number(text).alias("value"))


@query("b5_unit_from_parens", "SELECT p_partkey AS k, p_name AS variable, p_brand AS unit FROM part")
def _(v):
    return clean.split_units(v.table("part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("variable")))


@query("b6_unit_overrides", "SELECT variable, CASE variable WHEN 'R' THEN 'kg' WHEN 'A' THEN 't' ELSE unit END AS unit, count(*) AS n FROM indicator GROUP BY 1, 2", "indicator")
def _(v):
    return clean.unit_overrides(v.indicator, {"R": "kg", "A": "t"}).groupBy("variable", "unit").agg(F.count("*").alias("n"))


@query("b7_rename_values", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def _(v):
    return clean.rename_values(v.table("orders").select(F.col("o_orderstatus").alias("status")), "status", {"F": "finished", "O": "open"}).groupBy("status").agg(F.count("*").alias("n"))


@query("b8_layout_rules", "SELECT o_orderstatus AS area, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS value FROM orders")
def _(v):
    df = v.table("orders").select(F.concat("o_orderstatus", F.lit(" survey of "), F.year("o_orderdate")).alias("Survey"), F.col("o_totalprice").alias("Value"))
    return clean.layout_rules(df, {"Value": "value", "Missing": "x"}, "Survey").select("area", "year", "value")


@query("b9_compose_variable", "SELECT p_type || ', ' || p_brand AS variable, count(*) AS n FROM part GROUP BY 1")
def _(v):
    return clean.compose_variable(v.table("part"), "p_type", "p_brand").groupBy("variable").agg(F.count("*").alias("n"))


@query("b10_drop_ranged_years", "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 3 <> 0")
def _(v):
    year = F.year("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("-", year, year + 1)).otherwise(year.cast("string"))
    return clean.drop_ranged(v.table("orders").select(F.col("o_orderkey").alias("k"), text.alias("year")), "year")


@query("b11_expand_year_range", """SELECT o_custkey AS k, y AS year, CAST(CASE WHEN y = 1998 THEN 1 ELSE 2 END AS DOUBLE) AS value
    FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest([1997, 1998, 1999]) AS y)""")
def _(v):
    keys = v.table("orders").select(F.col("o_custkey").alias("k")).distinct()
    rows = keys.select("k", F.explode(F.array(F.struct(F.lit("1998").alias("year"), F.lit(1.0).alias("value")), F.struct(F.lit("1997-1999").alias("year"), F.lit(2.0).alias("value")))).alias("r")).select("k", "r.*")
    return clean.expand_year_range(rows)


@query("b12_wide_to_long", "SELECT o_orderkey AS k, unnest(['price', 'twice']) AS name, unnest([o_totalprice, 2 * o_totalprice]) AS value FROM orders")
def _(v):
    df = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), (2 * F.col("o_totalprice")).alias("twice"))
    return clean.wide_to_long(df, ["k"], ["price", "twice"], "name", "value")


@query("b13_long_to_wide", "SELECT state, variable, round(avg(value) FILTER (year = 1996), 6) AS y1996, round(avg(value) FILTER (year = 1997), 6) AS y1997 FROM indicator GROUP BY 1, 2", "indicator")
def _(v):
    wide = clean.long_to_wide(v.indicator, ["state", "variable"], "year", [1996, 1997])
    return wide.select("state", "variable", F.round("1996", 6).alias("y1996"), F.round("1997", 6).alias("y1997"))


@query("b14_constant_columns", "SELECT r_name, 'S' AS source, 1 AS month FROM region")
def _(v):
    return clean.constant_columns(v.table("region").select("r_name"), source="S", month=1)


@query("b15_split_date", "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def _(v):
    return clean.split_date(v.table("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d").groupBy("year", "month").agg(F.count("*").alias("n"))


@query("b16_range_filter", "SELECT state, count(*) AS n FROM indicator WHERE value BETWEEN 1 AND 5 GROUP BY 1", "indicator")
def _(v):
    return clean.range_filter(v.indicator, "value", 1, 5).groupBy("state").agg(F.count("*").alias("n"))


@query("b18_direction_coalesce", """SELECT CASE WHEN l_linenumber % 3 = 0 THEN s.n_name ELSE c.n_name END AS country, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE l_returnflag END AS state, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY ALL""")
def _(v):
    n = v.table("nation")
    src, dst = (n.select(F.col("n_nationkey").alias(f"{end[0]}_nationkey"), F.col("n_name").alias(f"{end}_country")) for end in ("customer", "supplier"))
    moves = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(src, "c_nationkey")
    moves = moves.join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(dst, "s_nationkey").select(
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("Incoming Migrants")).when(F.col("l_linenumber") % 3 == 1, F.lit("Outgoing Migrants")).alias("variable"),
        F.col("customer_country").alias("source_country"), F.col("supplier_country").alias("destination_country"), F.col("l_returnflag").alias("source_state"), F.col("l_linestatus").alias("destination_state"),
    )
    return clean.direction_coalesce(moves, ["country", "state"]).groupBy("country", "state").agg(F.count("*").alias("n"))


@query("b19_end_or_start_date", """SELECT CAST(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END AS INT) AS year, CAST(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 THEN month(o_orderdate) ELSE 13 - month(o_orderdate) END AS INT) AS month, count(*) AS n FROM orders GROUP BY ALL""")
def _(v):
    dated = v.table("orders").selectExpr(
        "year(o_orderdate) start_year", "month(o_orderdate) start_month", "case when o_orderkey % 3 = 0 then -1 when o_orderkey % 7 > 0 then year(o_orderdate) + 1 end end_year",
        "case when o_orderkey % 4 = 0 then 0 when o_orderkey % 5 > 0 then 13 - month(o_orderdate) end end_month",
    )
    return clean.end_or_start_date(dated).groupBy("year", "month").agg(F.count("*").alias("n"))


@query("b17_country_filter", "SELECT country, state, count(*) AS n FROM indicator WHERE country IN ('ASIA', 'EUROPE') GROUP BY ALL", "indicator")
def _(v):
    return clean.country_filter(v.indicator, ["ASIA", "EUROPE"]).groupBy("country", "state").agg(F.count("*").alias("n"))


@query("b20_daily_to_monthly", """SELECT month, CASE WHEN unit = 'O' THEN 'Monthly' ELSE unit END AS unit, round(sum(CASE WHEN unit = 'O' THEN value * [31,28,31,30,31,30,31,31,30,31,30,31][month] ELSE value END), 6) AS value FROM indicator GROUP BY 1, 2""", "indicator")
def _(v):
    df = v.indicator.withColumn("unit", F.when(F.col("unit") == "O", "Daily").otherwise(F.col("unit")))
    return clean.daily_to_monthly(df).groupBy("month", "unit").agg(F.round(F.sum("value"), 6).alias("value"))


@query("b21_percent_of_total", "SELECT variable, round(sum(CASE WHEN variable = 'R' THEN value / 100 * 5000 ELSE value END), 4) AS value FROM indicator GROUP BY 1", "indicator")
def _(v):
    return clean.percent_of_total(v.indicator, F.col("variable") == "R", 5000).groupBy("variable").agg(F.round(F.sum("value"), 4).alias("value"))


@query("b22_redacted_to_null", "SELECT p_partkey AS k, CASE WHEN p_size > 4 THEN CAST(p_size AS DOUBLE) END AS value FROM part")
def _(v):
    text = F.when(F.col("p_size") > 4, F.col("p_size").cast("string")).otherwise("*")
    return clean.redacted(v.table("part").select(F.col("p_partkey").alias("k"), text.alias("value")), "value")


@query("b23_title_case", "SELECT n_name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM nation")
def _(v):
    return v.table("nation").select("n_name", F.initcap("n_name").alias("title"))


@query("b24_strip_suffix_markup", "SELECT DISTINCT p_type AS name FROM part")
def _(v):
    return v.table("part").select(C.strip_markup(F.concat("p_type", F.lit("<br>.1"))).alias("name")).distinct()


@query("b25_header_sections", """SELECT l_orderkey AS file, l_linenumber AS line, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS section
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) QUALIFY l_linenumber % 3 <> 1""")
def _(v):
    rows = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("label"))
    df = rows.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "label", F.when(F.col("l_linenumber") % 3 != 1, F.col("label")).alias("cell"))
    return clean.header_sections(df, "file", "line", "label", ["cell"]).select("file", "line", "section")


@query("b26_resolve_region", "SELECT lower(n_name) AS region, CASE WHEN n_regionkey < 3 THEN n_name ELSE r_name END AS state, CASE WHEN n_regionkey < 3 THEN NULL ELSE n_name END AS county FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(v):
    n = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    states, counties = n.where("n_regionkey < 3").select(F.col("n_name").alias("state")), n.where("n_regionkey >= 3").select(F.col("n_name").alias("county"), F.col("r_name").alias("state"))
    return clean.resolve_region(n.select(F.lower("n_name").alias("region")), states, counties)


@query("b27_simplify_label", "SELECT DISTINCT replace(p_type, '_', ' ') || '/' || p_brand AS label FROM part")
def _(v):
    return v.table("part").select(C.simplify_label(F.concat_ws("/", F.lit("wm"), F.lit("x"), "p_type", "p_brand"), 2).alias("label")).distinct()


@query("b28_rename_groundings", "SELECT DISTINCT replace('wm/process/' || p_type, ' ', '_') AS name FROM part")
def _(v):
    return clean.rename_groundings(v.table("part").select(F.concat(F.lit("wm/concept/process/"), "p_type").alias("name")), "name", [("wm/concept/", "wm/")]).distinct()


@query("b29_position_year", "SELECT l_orderkey, l_linenumber, CAST(2018 - count(*) OVER (PARTITION BY l_orderkey) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS BIGINT) AS year FROM lineitem")
def _(v):
    return clean.position_year(v.table("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], 2017)


@query("c1_combine_sources", "SELECT n, sum(value) AS value FROM (SELECT 'c' AS n, c_custkey AS value FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier) GROUP BY 1")
def _(v):
    a = v.table("customer").select(F.lit("c").alias("n"), F.col("c_custkey").alias("value"), F.col("c_mktsegment").alias("extra"))
    b = v.table("supplier").select(F.lit("s").alias("n"), F.col("s_suppkey").alias("value"))
    none = a.select("n", F.lit(None).cast("long").alias("value"))
    return clean.combine_sources(a, b, none).groupBy("n").agg(F.sum("value").alias("value"))


@query("c2_distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(v):
    return clean.distinct_values(v.table("part"), "p_brand")


@query("c3_dedup_by_key", "SELECT year, month, min(value) AS value FROM indicator GROUP BY 1, 2", "indicator")
def _(v):
    return clean.dedup_by_key(v.indicator, ["year", "month"], "value")


@query("c4_shared_names", "SELECT c_nationkey AS name FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(v):
    return clean.shared_names(v.table("customer").select(F.col("c_nationkey").alias("name")), v.table("supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("name")))


@query("c5_remove_nodes", """SELECT 'edge' AS kind, src || '>' || dst AS name FROM edges WHERE src NOT IN ('n1', 'n2') AND dst NOT IN ('n1', 'n2') UNION ALL
    SELECT 'node', name FROM (SELECT src AS name FROM edges UNION SELECT dst FROM edges) WHERE name NOT IN ('n1', 'n2') UNION ALL SELECT 'missing', 'x' || n_nationkey FROM nation WHERE n_nationkey > 20""", "edges")
def _(v):
    gone = v.table("nation").where("n_nationkey IN (1, 2) OR n_nationkey > 20").selectExpr("concat(CASE WHEN n_nationkey > 20 THEN 'x' ELSE 'n' END, n_nationkey) AS name")
    nodes = v.edges.select(F.col("src").alias("name")).union(v.edges.select("dst")).distinct()
    left, kept, missing = clean.remove_nodes(nodes, v.edges, gone)
    return kept.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("name")).union(left.select(F.lit("node"), "name")).union(missing.select(F.lit("missing"), "name"))


@query("c5_remove_edges", """SELECT g.src, g.dst, CASE WHEN g.src NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) THEN 'bad source' WHEN g.dst NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) THEN 'bad target' ELSE 'no edge' END AS reason
    FROM (SELECT 'n' || c_nationkey AS src, 'c' || (c_custkey + 1) AS dst FROM customer UNION SELECT 'g' || c_mktsegment, 's' || c_custkey FROM customer UNION SELECT 'x' || c_custkey, 'c' || c_custkey FROM customer) g LEFT JOIN edges e ON g.src = e.src AND g.dst = e.dst WHERE e.src IS NULL""", "edges")
def _(v):
    told = "stack(3, concat('n', c_nationkey), concat('c', c_custkey + 1), concat('g', c_mktsegment), concat('s', c_custkey), concat('x', c_custkey), concat('c', c_custkey)) AS (src, dst)"
    gone = v.table("customer").selectExpr(told).distinct()
    nodes = v.edges.select(F.col("src").alias("name")).union(v.edges.select("dst")).distinct()
    return clean.remove_edges(nodes, v.edges, gone)[1]


@query("c6_union_timestamps", "SELECT DISTINCT ts_ms FROM obs", "obs")
def _(v):
    return clean.union_timestamps(v.obs, "ts_ms")
