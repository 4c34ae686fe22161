"""A Merkle manifest of a table, with a proof for every row, by nested-interval labels.

Every node carries the interval [lo, hi) of leaf ranks that it covers within its group. A level's
nodes are found in the next one by bucket, lo divided by the leaves of a full node, and by
containment of intervals; each parent holds at most FANOUT children, so that no bucket is hot.
A node's siblings are what is left of its parent's interval without its own: the children that
end before it and those that start behind it. Proofs are attached from the root down, a level a
join, so that only the last join, of 1/FANOUT as many parents, has as many rows as there are leaves.

Ranks come from a range partitioning of the digests and a count for each partition and group;
no group's rows meet in one task, texts never move, and all hashing is done by Spark's functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm._io import keep, require

#: Consecutive nodes that become one.
FANOUT = 8
_LOW_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the place within a partition
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts in UTF-8, put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """One field of a leaf: `-` for null, else its UTF-8 byte count, `:`, and its value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return digest(*map(field, values))


def proof(path: Column) -> Column:
    """H of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(path: Column, digest_: Column) -> Column:
    """The root that a leaf's digest gives along a path."""
    return F.aggregate(path, digest_, lambda acc, s: digest(s["left"], acc, s["right"]))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with lo (rank within grp by order, from 0), hi (lo + 1) and n (rows of the grp).

    Rows that tie in everything are told apart by their place, so that they too are spread.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange("grp", *order, "__tie").sortWithinPartitions("grp", *order, "__tie").drop("__tie")
    placed = placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))})
    placed = keep(placed, "ranked")
    runs = placed.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("grp")  # a row for each partition and group that meet
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = keep(runs.select("grp", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("n")), "runs")
    lo = F.col("__at") + F.col("__shift")
    return placed.join(runs, ["grp", "__part"]).withColumns({"lo": lo, "hi": lo + 1}).drop("__part", "__at", "__shift")


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT ** (level + 1)}").alias("bucket")


def _single(nodes: DataFrame) -> DataFrame:
    """The nodes that cover their whole group."""
    return nodes.where("lo = 0 AND hi = n")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """grp, n, lo, hi, digest and children of the nodes over those of a level, where a group has several."""
    several = nodes.where("NOT (lo = 0 AND hi = n)")
    runs = several.groupBy("grp", "n", _bucket(level)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    return runs.select("grp", "n", "lo", "hi", F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children")


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ranked leaves, from the lowest; empty without groups of several leaves."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, below = [], leaves
    while FANOUT ** len(levels) < most:
        below = keep(_parents(below, len(levels)), f"level{len(levels) + 1}")
        levels.append(below)
    return levels


def _attached(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """nodes of a level with top and path, from their parents' ones, by containment of intervals."""
    above = parents.select("grp", _bucket(level), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("children").alias("__children"), "top", F.col("path").alias("__above"))
    found = nodes.withColumn("bucket", _bucket(level)).join(above, ["grp", "bucket"]).where("__lo <= lo AND hi <= __hi")
    side = lambda inside: F.array_join(F.transform(F.filter("__children", inside), lambda c: c["digest"]), "")
    own = F.struct(side(lambda c: c["hi"] <= F.col("lo")).alias("left"), side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    return found.select(*nodes.columns, "top", F.concat(F.array(own), "__above").alias("path"))


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """leaves with top and path; tops: grp, top and the path from there up."""
    above = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1] if level else leaves
        found = _single(nodes).join(tops, "grp")
        if above is not None:
            found = found.select(*nodes.columns, "top", "path").union(_attached(nodes.where("NOT (lo = 0 AND hi = n)"), above, level))
        above = keep(found, f"paths{level}") if level else found
    return above


def manifest(df: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of df: `order`, digest, top (its group's root), root, path and the columns of carry.

    A leaf is the digest of the columns. Within a group (null is a group of its own) leaves
    ascend by `order`, null first, ties by digest; every FANOUT consecutive nodes become one until
    one is left, and the groups' roots, ordered by group (null first, then by UTF-8 bytes), give
    the root in the same way. path lists, from the leaf up, the digests left and right of the way.
    carry: columns computed from df's, under names that the result doesn't use otherwise.
    Rows that repeat are leaves of their own; other columns are left out, so that names can't
    clash. An empty table gives no rows.
    """
    require(df, *columns, group, order)
    carry = carry or {}
    key = F.col(group).cast("string")
    # "" for null, "=" before all else: groups keep their order and joins need no nulls
    rows = df.select(F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key)).alias("grp"), F.col(order).alias("__order"), leaf(*[F.col(c) for c in columns]).alias("digest"), *[c.alias(f"__carry_{name}") for name, c in carry.items()])
    leaves = _ranked(rows, ["__order", "digest"])
    levels = _tree(leaves)
    tops = None
    for nodes in (leaves, *levels):
        some = _single(nodes).select("grp", "digest")
        tops = some if tops is None else tops.union(some)
    tops = keep(tops.withColumnRenamed("grp", "member").withColumn("grp", F.lit("")), "tops")
    over = _ranked(tops, ["member"])
    upper = _tree(over)
    # One node covers all groups; without leaves there is none.
    start = _single(upper[-1] if upper else over).select("grp", F.col("digest").alias("top"), F.array().cast(_PATH).alias("path"))
    over = keep(_paths(over, upper, start).select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), F.col("top").alias("root"), "path"), "group_paths")
    root = over.select("root").first()
    found = _paths(leaves, levels, over.select("grp", F.col("subroot").alias("top"), "path"))
    return found.select(F.col("__order").alias(order), "digest", "top", F.lit(root and root["root"]).cast("string").alias("root"), "path", *[F.col(f"__carry_{name}").alias(name) for name in carry])
