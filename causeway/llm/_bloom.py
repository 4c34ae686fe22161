"""A blocked Bloom filter as a small table, built and probed with DataFrame functions.

The filter has a fixed number of 64-bit blocks, whatever the number of keys, so that the table
that is broadcast has a known bound. A key sets a few bits of one block. Where a probed key's
bits aren't all set, the key was never put in; otherwise it probably was, and an exact join decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets in its block.
PROBES = 4


def bits(key: Column, probes: int = PROBES) -> Column:
    """A mask of up to `probes` bits out of 64, from a hash of the key."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(probes):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def block(key: Column, blocks: int) -> Column:
    """The block of a key."""
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks)).cast("int")


def build(keys: DataFrame, key: str, blocks: int, probes: int = PROBES) -> DataFrame:
    """The filter of a column's values: block (int) and word (long), at most `blocks` rows."""
    return keys.select(block(F.col(key), blocks).alias("block"), bits(F.col(key), probes).alias("word")).groupBy("block").agg(F.bit_or("word").alias("word"))


def mark(df: DataFrame, key: str, filter_: DataFrame, blocks: int, into: str, probes: int = PROBES) -> DataFrame:
    """df with the boolean column `into`: false only for keys that were never put in (or null)."""
    names = df.columns
    # At most `blocks` rows of 12 bytes, by the modulus in block(): the size that is broadcast is bounded.
    words = F.broadcast(filter_.select(F.col("block").alias("__block"), F.col("word").alias("__word")))
    probed = df.withColumns({"__at": block(F.col(key), blocks), "__bits": bits(F.col(key), probes)}).join(words, F.col("__at") == F.col("__block"), "left")
    passed = F.col(key).isNotNull() & (F.coalesce(F.col("__word"), F.lit(0)).bitwiseAND(F.col("__bits")) == F.col("__bits"))
    return probed.select(*names, passed.alias(into))


def without(df: DataFrame, key: str, dropped: DataFrame, blocks: int = 1 << 20) -> DataFrame:
    """The rows of df whose key (not null) isn't among the values of dropped's one column.

    Only rows that the filter can't clear are shuffled for the exact anti-join.
    """
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone"))
    marked = mark(df, key, build(gone, "__gone", blocks), blocks, "__maybe")
    unsure = marked.where("__maybe").join(gone, F.col(key) == F.col("__gone"), "left_anti")
    return marked.where("NOT __maybe").union(unsure).drop("__maybe")
