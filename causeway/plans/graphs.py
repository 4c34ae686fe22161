"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import graph as I
from causeway.operators import scan
from causeway.plans.registry import query
from causeway.sources.writers import write_table

_WALK = """RECURSIVE walk AS (SELECT src, dst, [src, dst] AS path FROM {e} UNION ALL SELECT w.src, e.dst, list_append(w.path, e.dst) FROM walk w JOIN {e} e ON w.dst = e.src WHERE NOT list_contains(w.path, e.dst) AND len(w.path) <= {more})"""
#: More than the 3 edges of the graph's longest simple paths (nation, region, nation, customer), so that none is cut.
CUTOFF = 5


def _recursive(views: str, e: str, tail: str) -> str:
    """A recursive oracle: DuckDB wants RECURSIVE right after the first WITH."""
    from causeway.plans.views import SQL

    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in views.split()) + ", " + _WALK.format(e=e, more=CUTOFF).removeprefix("RECURSIVE ") + " " + tail


def _start(v, names=("n0", "n1")):
    return v.edges.select(F.col("src").alias("name")).where(F.col("name").isin(*names)).distinct()


@query("i1_successors", "SELECT DISTINCT dst AS name FROM edges WHERE src IN ('n0', 'n1')", "edges")
def _(v):
    return I.successors(v.edges, _start(v))


@query("i1_predecessors", "SELECT DISTINCT src AS name FROM edges WHERE dst IN ('n0', 'n1')", "edges")
def _(v):
    return I.predecessors(v.edges, _start(v))


@query("i2_k_hop", "SELECT name, CAST(min(h) AS INT) AS hops FROM (SELECT DISTINCT src AS name, 0 AS h FROM edges WHERE src = 'n0' UNION ALL SELECT dst, 1 FROM edges WHERE src = 'n0' UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'n0' UNION ALL SELECT c.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.src = 'n0') GROUP BY 1", "edges")
def _(v):
    return I.k_hop(v.edges, _start(v, ["n0"]), 3)


@query("i2_closure", _recursive("edges dag", "dag", "SELECT name, CAST(min(h) AS INT) AS hops FROM (SELECT dst AS name, len(path) - 1 AS h FROM walk WHERE src = 'n0' UNION ALL SELECT DISTINCT src, 0 FROM dag WHERE src = 'n0') GROUP BY 1").replace(f"<= {CUTOFF}", "<= 20"))
def _(v):
    return I.k_hop(v.dag, v.dag.where("src = 'n0'").select(F.col("src").alias("name")).distinct())


@query("i2_induced", "SELECT src, dst FROM edges WHERE src IN (SELECT dst FROM edges WHERE src = 'n0') AND dst IN (SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'n0') AND false OR (src IN (SELECT dst FROM edges WHERE src = 'n0' UNION SELECT 'n0') AND dst IN (SELECT dst FROM edges WHERE src = 'n0' UNION SELECT 'n0'))", "edges")
def _(v):
    return I.induced(v.edges, I.k_hop(v.edges, _start(v, ["n0"]), 1))


@query("i3_between", _recursive("edges", "edges", "SELECT DISTINCT unnest(path) AS name FROM walk WHERE src = 'n0' AND dst = 'c1'"))
def _(v):
    return I.between(v.edges, _start(v, ["n0"]), v.edges.where("dst = 'c1'").select(F.col("dst").alias("name")).distinct(), CUTOFF)


@query("i4_simple_paths", _recursive("edges", "edges", "SELECT src, dst, array_to_string(path, '>') AS path FROM walk"))
def _(v):
    return I.simple_paths(v.edges, CUTOFF).withColumn("path", F.array_join("path", ">"))


@query("i5_edge_to_paths", _recursive("edges dag", "dag", "SELECT DISTINCT path[i] AS a, path[i + 1] AS b, src, dst FROM (SELECT *, unnest(range(1, len(path))) AS i FROM walk)"))
def _(v):
    return I.edge_to_paths(I.simple_paths(v.dag, CUTOFF))


@query("i6_paths_within_start", _recursive("edges dag", "dag", "SELECT DISTINCT src, dst, unnest(path[:3]) AS name FROM walk"))
def _(v):
    return I.paths_within(I.simple_paths(v.dag, CUTOFF), 2)


@query("i6_paths_within_end", _recursive("edges dag", "dag", "SELECT DISTINCT src, dst, unnest(CASE WHEN len(path) <= 2 THEN path ELSE path[-3:] END) AS name FROM walk"))
def _(v):
    return I.paths_within(I.simple_paths(v.dag, CUTOFF), 2, False)


@query("i6_on_short_paths", _recursive("edges dag", "dag", "SELECT DISTINCT src, dst, unnest(path) AS name FROM walk WHERE len(path) <= 3"))
def _(v):
    return I.on_short_paths(I.simple_paths(v.dag, CUTOFF), 2)


@query("i7_prune", _recursive("edges dag", "dag", "SELECT src, dst FROM dag WHERE (src, dst) NOT IN (SELECT (src, dst) FROM walk WHERE len(path) - 1 >= 2 GROUP BY src, dst HAVING count(*) > 1)"))
def _(v):
    return I.prune_acyclic(v.dag, 2)


_CELLS = "e AS (SELECT src, dst, path, i, path[i] AS a, path[i + 1] AS b FROM (SELECT *, unnest(range(1, len(path))) AS i FROM walk)), f AS (SELECT d.draw, e.src, e.dst, e.path, product(tan(d.theta)) AS p FROM e JOIN draws d ON d.src = a AND d.dst = b GROUP BY ALL)"


def cells_sql(tail: str) -> str:
    return _recursive("edges dag", "dag", "").strip() + ", " + ", ".join(f"{v} AS ({__import__('causeway.plans.views', fromlist=['SQL']).SQL[v]})" for v in ("theta", "draws")) + ", " + _CELLS + " " + tail


@query("i8_cell_values", cells_sql("SELECT draw, src, dst, round(sum(p), 6) + 0.0 AS value FROM f GROUP BY ALL"))
def _(v):
    return I.cell_values(v.draws).withColumn("value", F.round("value", 6) + 0.0)


@query("i9_levels", _recursive("edges dag", "dag", "SELECT name, CAST(max(l) AS INT) AS level FROM (SELECT dst AS name, len(path) - 1 AS l FROM walk WHERE src NOT IN (SELECT dst FROM dag) UNION ALL SELECT src, 0 FROM dag WHERE src NOT IN (SELECT dst FROM dag)) GROUP BY 1").replace(f"<= {CUTOFF}", "<= 20"))
def _(v):
    return I.levels(v.dag)


@query("i10_influence_blanket", _recursive("edges dag", "dag", """, mn AS (SELECT DISTINCT unnest(path) AS name FROM walk WHERE src = 'r0' AND dst = 'c1'), side AS (SELECT DISTINCT src AS name FROM dag WHERE dst IN (SELECT name FROM mn WHERE substr(name, 1, 1) IN ('n', 'g')) AND src NOT IN (SELECT name FROM mn)),
    lit AS (SELECT dst, min(src) AS src FROM dag WHERE dst IN (SELECT name FROM side) GROUP BY dst HAVING min(src) LIKE 'g%'), am AS (SELECT name FROM (SELECT name FROM mn UNION SELECT dst FROM lit UNION SELECT src FROM lit) WHERE name NOT IN ('r0', 'c1'))
    SELECT name, 'main' AS role FROM am UNION ALL SELECT name, 'blanket' FROM side WHERE name NOT IN (SELECT dst FROM lit) AND name NOT IN (SELECT name FROM am)""").replace(" , mn AS", ", mn AS"))
def _(v):
    dag = write_table(v.dag, "dag")  # read many times below
    names = write_table(dag.select(F.col("src").alias("name")).union(dag.select("dst")).distinct(), "names")
    kind = F.substring("name", 1, 1)
    nodes = names.select("name", F.when(kind.isin("n", "g"), "function").otherwise("variable").alias("type"), F.when(kind == "g", "L").otherwise("F").alias("label"))
    return I.influence_blanket(dag, nodes, names.where("name = 'r0'"), "c1", CUTOFF)


@query("i11_pair_common_ancestor", _recursive("edges dag", "dag", """, up AS (SELECT DISTINCT src AS anc, dst AS name FROM walk UNION SELECT src, src FROM dag UNION SELECT dst, dst FROM dag), pr AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT pr.a, pr.b, x.anc FROM pr JOIN up x ON x.name = pr.a JOIN up y ON y.name = pr.b AND y.anc = x.anc)
    SELECT a, b, min(anc) AS ancestor FROM c WHERE NOT EXISTS (SELECT 1 FROM c d JOIN up u ON u.name = d.anc AND u.anc = c.anc AND u.anc <> u.name WHERE d.a = c.a AND d.b = c.b) GROUP BY ALL""").replace(" , up AS", ", up AS"))
def _(v):
    lines = v.table("orders").join(v.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = lines.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    return I.pair_common_ancestor(v.dag, pairs)


@query("i2_closure_orders", "SELECT 'n0' AS name, 0 AS hops UNION ALL SELECT DISTINCT 'c' || c_custkey, 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 0 UNION ALL SELECT 'o' || o_orderkey, CAST(2 + i // 2 AS INT) FROM placed JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 0", "placed")
def _(v):
    return I.k_hop(write_table(v.story, "story"), v.table("nation").where("n_nationkey = 0").select(F.lit("n0").alias("name")))


@query("i9_levels_orders", "SELECT DISTINCT src AS name, 0 AS level FROM story WHERE src LIKE 'n%' UNION ALL SELECT dst, 1 FROM story WHERE dst LIKE 'c%' UNION ALL SELECT 'o' || o_orderkey, CAST(i + 1 AS INT) FROM placed", "placed story")
def _(v):
    return I.levels(write_table(v.story, "story"))


_ORDER_THETA = "CAST((ascii(right(src, 1)) * 3 + ascii(right(dst, 1))) % 7 - 3 AS DOUBLE) / 10"


@query("i8_cell_values_orders", f"WITH RECURSIVE th AS (SELECT src, dst, tan({_ORDER_THETA}) AS f FROM story WHERE src NOT LIKE 'n%'), c AS (SELECT src, dst, f AS p FROM th UNION ALL SELECT c.src, th.dst, sum(c.p * th.f) FROM c JOIN th ON c.dst = th.src GROUP BY ALL) SELECT src, dst, round(sum(p), 9) + 0.0 AS value FROM c GROUP BY ALL", "placed story")
def _(v):
    """Cells of graphs as deep as customers have orders; their paths would be too many to be rows."""
    theta = v.story.where("src NOT LIKE 'n%'").select("src", "dst", F.expr(_ORDER_THETA).alias("theta"))
    return I.cell_values(theta, ()).withColumn("value", F.round("value", 9) + 0.0)


@query("i11_common_ancestor_orders", """WITH q AS (SELECT a.*, c_nationkey AS nat FROM placed a JOIN customer ON o_custkey = c_custkey), w AS (SELECT q.*, lead(o_orderkey) OVER o AS k2, lead(o_custkey) OVER o AS c2, lead(i) OVER o AS i2, lead(nat) OVER o AS n2 FROM q WINDOW o AS (PARTITION BY nat ORDER BY o_orderkey))
    SELECT 'o' || o_orderkey AS a, 'o' || k2 AS b, CASE WHEN o_custkey <> c2 THEN 'n' || nat WHEN i < i2 THEN 'o' || o_orderkey ELSE 'o' || k2 END AS ancestor FROM w WHERE k2 IS NOT NULL""", "placed")
def _(v):
    """Of each order and the next one from its nation: the earlier one if both are of one customer, else the nation."""
    o = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey")
    following = scan.pairwise(o, ["c_nationkey"], ["o_orderkey"], ["o_orderkey"]).where("next_o_orderkey IS NOT NULL")
    pairs = following.select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("o"), "next_o_orderkey").alias("b"))
    return I.pair_common_ancestor(write_table(v.story, "story"), write_table(pairs, "pairs"))


@query("i12_text_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def _(v):
    return I.text_distance(v.table("part"), "p_name", "p_type").select("p_partkey", F.col("distance").cast("long").alias("distance"))
