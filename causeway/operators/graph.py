"""Graph operators as iterative joins on edges(src, dst).

A loop's state is written to the shared folder every round, so that neither lineage nor plan grows
and a lost executor costs a round's files at most. Rounds are bounded by the caller's depth or cutoff.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources.writers import fresh_path, write_table

#: Paths beyond which simple_paths() refuses to go on.
MOST_PATHS = 100_000_000
#: Written rounds that a plan holds side by side.
MOST_ROUNDS = 8
#: Nodes with edges that lead on, of which there are so few that rows are told by them where they are.
FEW = 1 << 16


def successors(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name")).distinct()


def predecessors(edges: DataFrame, names: DataFrame) -> DataFrame:
    return successors(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), names)


def k_hop(edges: DataFrame, start: DataFrame, depth: int = -1, inward: bool = False) -> DataFrame:
    """name and hops of the nodes within `depth` hops along (or against) edges; -1: without limit."""
    ways = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if inward else edges.select("src", "dst")
    front = write_table(start.select("name", F.lit(0).alias("hops")).distinct(), "front")
    found, hop = [front], 0
    while depth < 0 or hop < depth:
        hop += 1
        new = front.select(F.col("name").alias("src")).join(ways, "src").select(F.col("dst").alias("name")).distinct().join(_together(found).select("name"), "name", "left_anti")
        front = write_table(new.withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        found = _appended(found, front)
    return _together(found)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _appended(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Rounds are kept as they were written; many are put into one, so that the plan stays small."""
    parts = [*parts, new]
    return parts if len(parts) < MOST_ROUNDS else [write_table(_together(parts), "rounds")]


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of which both ends are among the names."""
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select(*edges.columns)


def simple_paths(edges: DataFrame, cutoff: int, src: DataFrame | None = None, dst: DataFrame | None = None, most: int = MOST_PATHS) -> DataFrame:
    """src, dst and path (array of names) of all directed simple paths of up to `cutoff` edges.

    src and dst (name) restrict the ends. With both, paths grow from both ends to the middle, over
    edges that lie on a way of at most `cutoff` edges between them. More than `most` (half) paths
    fail: their number can be exponential in the cutoff, which is therefore required.
    """
    if cutoff < 1:
        raise ValueError("cutoff must be at least 1")
    ways = edges.select("src", "dst").where("src <> dst").distinct()
    if src is not None and dst is not None:
        return _two_sided(ways, cutoff, src, dst, most)
    first = ways if src is None else ways.join(src.select(F.col("name").alias("src")).distinct(), "src", "left_semi")
    out = _together(_grown(ways, first, cutoff, most))
    return out if dst is None else out.join(dst.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst", "path")


def _grown(ways: DataFrame, first: DataFrame, cutoff: int, most: int) -> list[DataFrame]:
    """Simple paths that begin with the edges of first, a table for each length up to cutoff."""
    level = write_table(first.select("src", "dst", F.array("src", "dst").alias("path")), "paths")
    levels, total = [level], level.count()
    for _ in range(1, cutoff):
        if total > most:
            raise ValueError(f"more than {most} paths")
        longer = level.select("src", F.col("dst").alias("__at"), "path").join(ways.select(F.col("src").alias("__at"), F.col("dst").alias("__next")), "__at").where(~F.array_contains("path", F.col("__next")))
        level = write_table(longer.select("src", F.col("__next").alias("dst"), F.concat("path", F.array("__next")).alias("path")), "paths")
        n = level.count()
        if not n:
            break
        total += n
        levels.append(level)
    return levels


def _two_sided(ways: DataFrame, cutoff: int, src: DataFrame, dst: DataFrame, most: int) -> DataFrame:
    """Paths from src to dst: halves from either end that meet in one node and share no other."""
    down, up = k_hop(ways, src, cutoff), k_hop(ways, dst, cutoff, inward=True)
    near = ways.join(down.select(F.col("name").alias("src"), F.col("hops").alias("__from")), "src").join(up.select(F.col("name").alias("dst"), F.col("hops").alias("__to")), "dst")
    near = write_table(near.where(F.col("__from") + 1 + F.col("__to") <= cutoff).select("src", "dst"), "near")
    half = (cutoff + 1) // 2
    starts = src.select(F.col("name").alias("src")).distinct()
    ends = dst.select(F.col("name").alias("dst")).distinct()
    forward = _grown(near, near.join(starts, "src", "left_semi"), half, most)
    out = [level.join(ends, "dst", "left_semi").select("src", "dst", "path") for level in forward]
    if len(forward) == half and cutoff > half:
        back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        backward = _grown(back, back.join(ends.select(F.col("dst").alias("src")), "src", "left_semi"), cutoff - half, most)
        behind = _together(backward).select(F.col("dst").alias("__meet"), F.col("src").alias("__end"), F.reverse("path").alias("__rest"))
        both = forward[-1].withColumnRenamed("dst", "__meet").join(behind, "__meet").withColumn("__rest", F.slice("__rest", 2, cutoff))
        out.append(both.where(~F.arrays_overlap("path", "__rest")).select("src", F.col("__end").alias("dst"), F.concat("path", "__rest").alias("path")))
    return _together(out)


def between(edges: DataFrame, src: DataFrame, dst: DataFrame, cutoff: int) -> DataFrame:
    """Nodes on simple paths of up to cutoff edges from src to dst."""
    return simple_paths(edges, cutoff, src, dst).select(F.explode("path").alias("name")).distinct()


def path_edges(paths: DataFrame) -> DataFrame:
    """src, dst (the path's ends), path_id, pos, a and b of each edge of each path."""
    numbered = paths.select("src", "dst", "path", F.xxhash64("path").alias("path_id"))
    each = numbered.select("src", "dst", "path_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("pos", "e"))
    return each.select("src", "dst", "path_id", "pos", "e.a", "e.b")


def edge_to_paths(paths: DataFrame) -> DataFrame:
    """a, b (an edge), src, dst: the cells that depend on the edge."""
    return path_edges(paths).select("a", "b", "src", "dst").distinct()


def paths_within(paths: DataFrame, hops: int, from_start: bool = True) -> DataFrame:
    """Nodes in the first (or last) hops of each pair's paths."""
    part = F.slice("path", 1, hops + 1) if from_start else F.when(F.size("path") <= hops, F.col("path")).otherwise(F.slice("path", -(hops + 1), hops + 1))
    return paths.select("src", "dst", F.explode(part).alias("name")).distinct()


def on_short_paths(paths: DataFrame, hops: int) -> DataFrame:
    """Nodes on paths of up to `hops` edges."""
    return paths.where(F.size("path") <= hops + 1).select("src", "dst", F.explode("path").alias("name")).distinct()


def prune(edges: DataFrame, paths: DataFrame, cutoff: int = 2) -> DataFrame:
    """Without the edges whose ends have more than one simple path of at least `cutoff` edges,
    judged on the paths as given."""
    several = paths.groupBy("src", "dst").agg(F.count_if(F.size("path") - 1 >= cutoff).alias("n")).where("n > 1")
    return edges.join(several, ["src", "dst"], "left_anti").select(*edges.columns)


def cell_values_on_paths(paths: DataFrame, theta: DataFrame, key: tuple[str, ...] = ("draw",)) -> DataFrame:
    """For each draw and pair, the sum over paths of the product of tan(theta) along the path.

    A path's factors are as many as it has edges; their product keeps its sign.
    """
    factors = path_edges(paths).join(theta.select(*key, F.col("src").alias("a"), F.col("dst").alias("b"), F.tan("theta").alias("f")), ["a", "b"])
    product = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]), F.lit(1.0), lambda t, f: t * f)
    each = factors.groupBy(*key, "src", "dst", "path_id").agg(product.alias("p"))
    return each.groupBy(*key, "src", "dst").agg(F.sum("p").alias("value"))


def _lengths(factors: DataFrame, key: tuple[str, ...], total) -> list[str]:
    """Paths of tables of key, src, dst and value summed over the paths of 1, 2, ... edges of an acyclic graph, one for each length.

    factors: key, src, dst, value. Only the last length's rows meet the edges again, and paths that
    share their ends are one row. A cycle shows as a path from a node to itself, and fails. Each
    length is written once: several are read as one table, however many they are.
    """
    spark = factors.sparkSession
    path = fresh_path(spark, "cells")
    front = edges = write_table(factors.select(*key, "src", "dst", "value"), "cells", path)
    step = edges.select(*key, F.col("src").alias("__at"), F.col("dst").alias("__next"), F.col("value").alias("__f"))
    inner = write_table(step.select("__at").distinct(), "inner")
    few = inner.count() <= FEW
    out = []
    while True:
        n, loops = front.agg(F.count("*"), F.count_if(F.col("src") == F.col("dst"))).first()
        if loops:
            raise ValueError("the graph has a cycle; sum over its simple paths instead")
        if not n:
            return out
        out.append(path)
        ahead = front.withColumnRenamed("dst", "__at")
        if few:  # most paths end here: what goes on is written, so that Spark knows how little it is and leaves the edges where they are
            ahead = write_table(ahead.join(F.broadcast(inner), "__at", "left_semi"), "ahead")
        longer = ahead.join(step, [*key, "__at"])
        path = fresh_path(spark, "cells")
        front = write_table(longer.groupBy(*key, "src", F.col("__next").alias("dst")).agg(total(F.col("value") * F.col("__f")).alias("value")), "cells", path)


def cell_values(theta: DataFrame, key: tuple[str, ...] = ("draw",)) -> DataFrame:
    """For each draw and pair of an acyclic graph, the sum over paths of the product of tan(theta) along the path.

    theta: key, src, dst, theta, one row for each key and edge. Sums of paths of one length give
    those of the next by one join, so that no path is ever a row.
    """
    factors = theta.select(*key, "src", "dst", F.tan("theta").alias("value"))
    lengths = _lengths(factors, key, F.sum)
    cells = theta.sparkSession.read.schema(factors.schema).parquet(*lengths) if lengths else factors
    # dealt by where they lead to, so that sums for a node find its cells together, and by src, so that a node of many is in several tasks
    cells = cells.repartitionByRange(*key, "dst", "src")
    return cells.groupBy(*key, "src", "dst").agg(F.sum("value").alias("value"))


def prune_acyclic(edges: DataFrame, cutoff: int = 2) -> DataFrame:
    """prune() of an acyclic graph by counts of paths of each length (2 stands for more), without paths."""
    factors = edges.select("src", "dst", F.lit(1).cast("long").alias("value")).distinct()
    long = _lengths(factors, (), lambda n: F.least(F.sum(n), F.lit(2)))[cutoff - 1 :]
    if not long:
        return edges
    several = edges.sparkSession.read.schema(factors.schema).parquet(*long).groupBy("src", "dst").agg(F.sum("value").alias("n")).where("n > 1")
    return edges.join(several, ["src", "dst"], "left_anti").select(*edges.columns)


def levels(edges: DataFrame, most: int = 100) -> DataFrame:
    """name and level: the longest way from a node without predecessors; a cycle fails after `most` rounds."""
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    heads = nodes.join(edges.select(F.col("dst").alias("name")), "name", "left_anti")
    front = write_table(heads.withColumn("level", F.lit(0)), "levels")
    found = [front]
    for k in range(1, most + 1):
        front = write_table(front.select(F.col("name").alias("src")).join(edges, "src").select(F.col("dst").alias("name")).distinct().withColumn("level", F.lit(k)), "front")
        if front.isEmpty():
            return _together(found).groupBy("name").agg(F.max("level").alias("level"))
        found = _appended(found, front)
    raise ValueError(f"no end after {most} levels: the graph has a cycle")


def influence_blanket(edges: DataFrame, nodes: DataFrame, shared: DataFrame, output: str, cutoff: int) -> DataFrame:
    """name and role (main or blanket) around the paths from shared inputs to the output.

    nodes: name, type (variable or function), label. Side inputs of functions on the paths come
    with them: one made by a literal's function is main along with that function; one named
    ::IF_ is main with its function, whose inputs are placed in turn; any other is blanket.
    """
    ends = shared.where(F.col("name") != output)
    target = nodes.where(F.col("name") == output).select("name")
    main = write_table(between(edges, ends, target, cutoff), "main")
    functions = nodes.where("type = 'function'").select("name")
    into = lambda names: edges.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")).distinct()
    side = into(main.join(functions, "name", "left_semi")).join(main, "name", "left_anti")
    ifs = side.where(F.col("name").contains("::IF_"))
    if_functions = edges.join(ifs.withColumnRenamed("name", "dst"), "dst", "left_semi").groupBy("dst").agg(F.min("src").alias("name")).select("name")
    placed = side.where(~F.col("name").contains("::IF_")).union(into(if_functions)).distinct()
    maker = edges.join(placed.withColumnRenamed("name", "dst"), "dst", "left_semi").groupBy("dst").agg(F.min("src").alias("src"))
    literal = maker.join(nodes.where("label = 'L'").select(F.col("name").alias("src")), "src", "left_semi")
    blanket = placed.join(literal.select(F.col("dst").alias("name")), "name", "left_anti")
    all_main = main.union(ifs).union(if_functions).union(literal.select("dst")).union(literal.select("src")).distinct()
    all_main = all_main.join(shared, "name", "left_anti").where(F.col("name") != output)
    return all_main.withColumn("role", F.lit("main")).union(blanket.join(all_main, "name", "left_anti").withColumn("role", F.lit("blanket")))


def ancestors(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name and anc: each of the names with itself and all nodes that lead to it, at any distance.

    Semi-naive: only the pairs of the last round meet the edges, until none is new; cycles end too.
    """
    ways = edges.select(F.col("src").alias("__up"), F.col("dst").alias("anc")).where("__up <> anc").distinct()
    front = write_table(names.select("name", F.col("name").alias("anc")).distinct(), "front")
    found = [front]
    while True:
        new = front.join(ways, "anc").select("name", F.col("__up").alias("anc")).distinct()
        front = write_table(new.join(_together(found), ["name", "anc"], "left_anti"), "front")
        if front.isEmpty():
            return _together(found)
        found = _appended(found, front)


def pair_common_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and a lowest common ancestor in an acyclic graph: one with no descendant that is common too;
    of several the first by name. Nodes are their own ancestors. Pairs without one give no row.

    All nodes on a way between two common ancestors are common as well, so that one edge from a
    common ancestor to another tells that it isn't lowest.
    """
    asked = pairs.select("a", "b").distinct()
    up = write_table(ancestors(edges, asked.select(F.explode(F.array("a", "b")).alias("name"))), "ancestors")
    common = write_table(asked.join(up.withColumnRenamed("name", "a"), "a").join(up.withColumnRenamed("name", "b"), ["b", "anc"]).select("a", "b", "anc"), "common")
    higher = common.withColumnRenamed("anc", "dst").join(edges.select("src", "dst").where("src <> dst"), "dst").select("a", "b", F.col("src").alias("anc"))
    return common.join(higher, ["a", "b", "anc"], "left_anti").groupBy("a", "b").agg(F.min("anc").alias("ancestor"))


def text_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Levenshtein distance of two texts."""
    return df.withColumn("distance", F.levenshtein(a, b))


def rank_within(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """df with place (from 1) of each row within its key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
