"""The library's tables as views of a directory of business and event tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import scan

SQL = {
    "indicator": """SELECT r_name AS country, n_name AS state, CAST(NULL AS VARCHAR) AS county, 'L' AS source, l_linestatus AS unit, l_returnflag AS variable,
        CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_quantity AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "obs": "SELECT event_type AS concept, 'i_' || event_type AS indicator, epoch_us(ts) // 1000 AS ts_ms, value FROM events",
    "steps": """SELECT o_orderpriority AS concept, 'i_' || o_orderpriority AS indicator, CAST(12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 1 AS INT) AS step, o_totalprice AS value FROM orders""",
    "means": "SELECT concept, indicator, step, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) / 100 AS value FROM steps GROUP BY ALL",
    "evidence": """SELECT CAST(l_orderkey AS BIGINT) AS stmt, CAST(l_linenumber AS INT) AS evid, 'n' || c_nationkey AS subj, 'n' || s_nationkey AS obj, 1 - l_discount AS belief,
        l_quantity / 50 AS subj_score, (o_totalprice % 100) / 100 AS obj_score, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS subj_pol, CASE l_linestatus WHEN 'F' THEN -1 ELSE 1 END AS obj_pol,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE o_orderpriority END AS subj_adj, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE o_orderstatus END AS obj_adj
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "edges": """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
        UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'g' || c_mktsegment, 'c' || c_custkey FROM customer
        UNION SELECT unnest(['r' || n_regionkey, 'r' || n_regionkey]), unnest(['g' || c_mktsegment, 'c' || c_custkey]) FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "dag": "SELECT src, dst FROM edges WHERE NOT (src LIKE 'n%' AND dst LIKE 'r%')",
    "placed": "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders",
    "story": """SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM placed WHERE i = 1
        UNION ALL SELECT 'o' || a.o_orderkey, 'o' || b.o_orderkey FROM placed a JOIN placed b ON a.o_custkey = b.o_custkey AND b.i - a.i BETWEEN 1 AND 2""",
    "concept_map": "SELECT p_type AS concept, 'P' AS source, p_brand AS indicator, p_retailprice / 1000 AS score FROM part",
    "responses": "SELECT o_orderpriority AS adjective, CAST(o_orderkey % 101 - 50 AS DOUBLE) / 50 AS response FROM orders",
    "timings": "SELECT CAST(o_custkey % 8 AS INT) AS nodes, CAST(o_orderkey % 4 AS INT) AS edges, o_orderstatus AS kind, o_totalprice AS wall, o_totalprice / 2 AS cpu FROM orders",
    "theta": "SELECT src, dst, CAST((ascii(substr(src, 2)) * 7 + ascii(right(dst, 1)) * 3) % 19 - 9 AS DOUBLE) / 10 AS theta FROM dag",
    "draws": "SELECT CAST(d AS INT) AS draw, src, dst, theta + CAST(d AS DOUBLE) / 20 AS theta FROM theta, range(0, 10) t(d)",
    "forecast": "SELECT CAST(l_linenumber AS INT) AS step, l_returnflag AS indicator, CAST(l_orderkey AS BIGINT) AS sample, l_extendedprice AS value FROM lineitem",
}


class Views:
    """Tables of a directory, and the library's tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def indicator(self) -> DataFrame:
        li, s, n, r = (self.table(t) for t in ("lineitem", "supplier", "nation", "region"))
        rows = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return rows.select(
            F.col("r_name").alias("country"), F.col("n_name").alias("state"), F.lit(None).cast("string").alias("county"), F.lit("L").alias("source"), F.col("l_linestatus").alias("unit"),
            F.col("l_returnflag").alias("variable"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("value"),
        )

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("concept"), F.concat(F.lit("i_"), "event_type").alias("indicator"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")

    @cached_property
    def steps(self) -> DataFrame:
        step = 12 * (F.year("o_orderdate") - 1990) + F.month("o_orderdate") - 1
        return self.table("orders").select(F.col("o_orderpriority").alias("concept"), F.concat(F.lit("i_"), "o_orderpriority").alias("indicator"), step.alias("step"), F.col("o_totalprice").alias("value"))

    @cached_property
    def means(self) -> DataFrame:
        cents = F.sum(F.round(F.col("value") * 100).cast("long"))  # whole numbers: any order of adding gives the same mean
        return self.steps.groupBy("concept", "indicator", "step").agg((cents.cast("double") / F.count("value") / 100).alias("value"))

    @cached_property
    def _joined(self) -> DataFrame:
        o, c, li, s = (self.table(t) for t in ("orders", "customer", "lineitem", "supplier"))
        homes = o.join(c, o.o_custkey == c.c_custkey)  # before the many lines, which move once less
        return li.join(homes, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)

    @cached_property
    def evidence(self) -> DataFrame:
        return self._joined.select(
            F.col("l_orderkey").cast("long").alias("stmt"), F.col("l_linenumber").alias("evid"), F.concat(F.lit("n"), "c_nationkey").alias("subj"), F.concat(F.lit("n"), "s_nationkey").alias("obj"),
            (1 - F.col("l_discount")).alias("belief"), (F.col("l_quantity") / 50).alias("subj_score"), (F.col("o_totalprice") % 100 / 100).alias("obj_score"),
            F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("subj_pol"), F.when(F.col("l_linestatus") == "F", -1).otherwise(1).alias("obj_pol"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("o_orderpriority")).alias("subj_adj"), F.when(F.col("l_linenumber") % 4 != 0, F.col("o_orderstatus")).alias("obj_adj"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Regions (r), nations (n), market segments (g), customers (c) and suppliers (s) of all rows: a
        nation leads back to its region, all other edges lead down. A customer adds a few edges and paths,
        so that both grow with the tables."""
        n, c, s = (self.table(t) for t in ("nation", "customer", "supplier"))
        name = lambda kind, key: F.concat(F.lit(kind), key)
        ends = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
        region, nation = name("r", "n_regionkey"), name("n", "n_nationkey")
        customer, segment = name("c", "c_custkey"), name("g", "c_mktsegment")
        places = n.select(F.explode(F.array(ends(region, nation), ends(nation, region))).alias("e"))
        suppliers = s.select(ends(name("n", "s_nationkey"), name("s", "s_suppkey")).alias("e"))
        above = F.array(ends(name("n", "c_nationkey"), customer), ends(segment, customer), ends(region, segment), ends(region, customer))
        customers = c.join(n, c.c_nationkey == n.n_nationkey).select(F.explode(above).alias("e"))
        return places.union(suppliers).union(customers).select("e.*").distinct()

    @cached_property
    def dag(self) -> DataFrame:
        return self.edges.where("NOT (src LIKE 'n%' AND dst LIKE 'r%')")

    @cached_property
    def story(self) -> DataFrame:
        """Nations lead to customers, customers to their first order, and each order to the next two of its customer:
        as deep as a customer has orders, with ever more ways to the later ones."""
        orders = self.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
        rows, w = scan.neighbourly(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], before=2)
        rows = rows.withColumns({f"before{k}": F.lag("o_orderkey", k).over(w) for k in (1, 2)}).where("__own")
        order = lambda c: F.concat(F.lit("o"), c)
        first = F.when(F.col("index") == 0, F.concat(F.lit("c"), "o_custkey"))
        found = rows.select(F.explode(F.array_compact(F.array(first, order("before1"), order("before2")))).alias("src"), order("o_orderkey").alias("dst"))
        homes = self.table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
        return homes.union(found)

    @cached_property
    def concept_map(self) -> DataFrame:
        return self.table("part").select(F.col("p_type").alias("concept"), F.lit("P").alias("source"), F.col("p_brand").alias("indicator"), (F.col("p_retailprice") / 1000).alias("score"))

    @cached_property
    def responses(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderpriority").alias("adjective"), ((F.col("o_orderkey") % 101 - 50).cast("double") / 50).alias("response"))

    @cached_property
    def timings(self) -> DataFrame:
        return self.table("orders").selectExpr("cast(o_custkey % 8 as int) nodes", "cast(o_orderkey % 4 as int) edges", "o_orderstatus kind", "o_totalprice wall", "o_totalprice / 2 cpu")

    @cached_property
    def theta(self) -> DataFrame:
        return self.dag.selectExpr("src", "dst", "cast((ascii(substr(src, 2)) * 7 + ascii(right(dst, 1)) * 3) % 19 - 9 as double) / 10 theta")

    @cached_property
    def draws(self) -> DataFrame:
        return self.theta.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("draw", "src", "dst", (F.col("theta") + F.col("draw").cast("double") / 20).alias("theta"))

    @cached_property
    def forecast(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("indicator"), F.col("l_orderkey").cast("long").alias("sample"), F.col("l_extendedprice").alias("value"))
