"""Linking the members of buckets without emitting all their pairs.

Two ids that share a key are a candidate pair. In each of a few rounds every member of a bucket
is held against one member of it; what is linked becomes one component. A round draws its
members by one order of all ids, so that the keys of a group agree on one of it and its pairs
are as many as its members, however many keys they share. Only pairs of a bucket whose
components still differ are then tested one by one: no link between components is lost, and a
group of copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import _bloom
from causeway.llm._components import connected_components
from causeway.llm._io import keep

#: What turns the order of ids about in each round of draws.
SALTS = (0, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
#: Blocks of the Bloom filters that thin rows out before a shuffle: at most 2**20 rows of 12 bytes.
BLOCKS = 1 << 20


def _drawn(salt: int) -> Column:
    """The member of a bucket whose id is nearest to the salt by exclusive or."""
    return F.min(F.col("id").bitwiseXOR(F.lit(salt))).bitwiseXOR(F.lit(salt)).alias("drawn")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    u, v = (F.col(c) for c in pairs.columns)
    return pairs.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a < b").distinct()


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, id and part (component) of the buckets that hold several components."""
    labelled = members.select("key", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    several = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    return keep(labelled.join(several, "key"), "mixed")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts with the components that new links (a, b) connect made one: each is a star already, so that few rounds are left."""
    return connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))


def link_buckets(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame], crowd: int = 0) -> DataFrame:
    """node and component of every id that is linked with another.

    keys: key and id (both long); rows may repeat. verify: of pairs (a, b), those that are links. across: from the
    rows (key, id, part) of mixed buckets, the pairs of different parts that may be links. Only buckets of more rows than
    crowd are drawn from again: the pairs of smaller ones are few enough to be tested at once.
    """
    buckets = keep(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key", "a"), "buckets")
    shared = _bloom.mark(keys, "key", _bloom.build(buckets, "key", BLOCKS), BLOCKS, "__shared").where("__shared").drop("__shared")
    members = keep(shared.join(buckets, "key"), "members")

    tested = keep(ordered(members.select("a", "id")), "pairs")
    parts = connected_components(keep(verify(tested), "links"))
    mixed = _mixed(members, parts)
    for salt in SALTS[1:]:
        if mixed.isEmpty():
            return parts
        drawn = mixed.groupBy("key").agg(_drawn(salt), *[F.count("*").alias("n")] * (crowd > 0))
        stars = ordered(mixed.join(drawn.where(F.col("n") > crowd) if crowd else drawn, "key").select("drawn", "id"))
        stars = keep(stars.join(tested, ["a", "b"], "left_anti"), "pairs")
        if crowd and stars.isEmpty():
            break
        tested = tested.union(stars)
        parts = _joined(parts, keep(verify(stars), "links"))
        mixed = _mixed(mixed, parts)

    rest = keep(ordered(across(mixed)).join(tested, ["a", "b"], "left_anti"), "pairs")
    if rest.isEmpty():
        return parts
    return _joined(parts, verify(rest))
