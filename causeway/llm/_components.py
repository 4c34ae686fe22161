"""Connected components by alternating large and small stars, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from causeway.llm._io import keep


def _state(edges: DataFrame) -> Row:
    """A count and a hash that two sets of edges only share if they are the same."""
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for each node of a pair of two nodes.

    A round points every node's larger neighbours, then its smaller ones, at the smallest
    neighbour, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. A node's neighbours are never gathered: the smallest is an aggregate with
    partial sums before the shuffle, and rows are told of it by an equi-join that Spark may split.
    """
    edges = keep(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(least.select("u", "m")).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
