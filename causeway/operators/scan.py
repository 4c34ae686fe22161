"""Scans, neighbours and order statistics of few or huge keys, without a task that holds a whole key.

Rows are range-partitioned by key and order and written once; a count for each key and partition,
summed up over the partitions, then gives every row its place within its key. What needs rows side
by side runs in chunks of CHUNK consecutive rows with a few rows of their neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources.writers import write_table

#: Consecutive rows of a key that are worked on together.
CHUNK = 1 << 16
_LOW_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the place within a partition


def met(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls of the key are equal, with the key once."""
    named = right.select(*[F.col(c).alias(f"__r_{c}" if c in key else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in key])
    return left.join(named, same, how).drop(*[f"__r_{c}" for c in key])


def spread(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df, written in range partitions by key and order, with __part and __at (the place in it)."""
    rows = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    return write_table(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))}), "spread")


def _carried(rows: DataFrame, key: Sequence[str], own: Column) -> DataFrame:
    """key, __part, __first, __own, __before (own of the key's earlier partitions) and __total: a row for each key and partition."""
    parts = rows.groupBy(*key, "__part").agg(F.min("__at").alias("__first"), own.alias("__own"))
    w = Window.partitionBy(*key)
    before = F.coalesce(F.sum("__own").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumns({"__before": before, "__total": F.sum("__own").over(w)})


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], index: str = "index", total: str = "n") -> DataFrame:
    """df with each row's place within its key, from 0, and the key's number of rows. Null keys are a key."""
    rows = spread(df, key, order)
    parts = _carried(rows, key, F.count("*"))
    placed = met(rows, parts, [*key, "__part"])
    return placed.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(index), F.col("__total").alias(total))


def neighbourly(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], before: int = 0, after: int = 0, chunk: int = CHUNK) -> tuple[DataFrame, Window]:
    """numbered(df) in chunks with `before` and `after` rows of the neighbours, and a window over a chunk in order.

    __own tells the rows of a chunk from those it borrows: after windows are applied, keep only these.
    """
    if max(before, after) > chunk:
        raise ValueError(f"a chunk of {chunk} rows can't reach {max(before, after)} rows back or ahead")
    at, place = F.floor(F.col("index") / chunk), F.col("index") % chunk
    copies = [F.struct(at.alias("c"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(place >= chunk - before, F.struct((at + 1).alias("c"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when((place < after) & (at > 0), F.struct((at - 1).alias("c"), F.lit(False).alias("own"))))
    rows = numbered(df, key, order).withColumn("__copy", F.explode(F.array_compact(F.array(*copies))))
    rows = rows.withColumns({"__chunk": F.col("__copy.c"), "__own": F.col("__copy.own")}).drop("__copy")
    return rows, Window.partitionBy(*key, "__chunk").orderBy("index")


def pairwise(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], columns: Sequence[str], prefix: str = "next_", chunk: int = CHUNK) -> DataFrame:
    """df with the columns of the row that follows within its key, null for the last."""
    rows, w = neighbourly(df, key, order, after=1, chunk=chunk)
    return rows.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns}).where("__own").select(*df.columns, *[f"{prefix}{c}" for c in columns])


def gaps(df: DataFrame, key: Sequence[str], value: str, chunk: int = CHUNK) -> DataFrame:
    """key, value and gap (to the value before it) of distinct values, but for a key's first."""
    rows, w = neighbourly(df.select(*key, value).distinct(), key, [value], before=1, chunk=chunk)
    return rows.withColumn("gap", F.col(value) - F.lag(value).over(w)).where("__own AND gap IS NOT NULL").select(*key, value, "gap")


def grouper(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], size: int, group: str = "group") -> DataFrame:
    """df with the number (from 0) of each row's group of `size` consecutive rows within its key; the last may be smaller."""
    return numbered(df, key, order).select(*df.columns, F.floor(F.col("index") / size).alias(group))


def chunked(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], fields: Sequence[str], size: int, into: str = "items") -> DataFrame:
    """key, n (the key's rows), part (from 0) and a list of up to `size` rows in order: no list grows with its key."""
    rows = numbered(df, key, order).withColumn("part", F.floor(F.col("index") / size))
    listed = F.array_sort(F.collect_list(F.struct("index", *fields)))
    return rows.groupBy(*key, "n", "part").agg(F.transform(listed, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(into))


def take(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first k rows of each key; each task passes on k rows of a key at most."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def running(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], value: str, into: str = "scan", chunk: int = CHUNK) -> DataFrame:
    """df with the sum of a column up to and with each row within its key; nulls add nothing."""
    rows, w = neighbourly(df, key, order, chunk=chunk)
    rows = write_table(rows, "chunks")
    sums = rows.groupBy(*key, "__chunk").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    sums = sums.select(*key, "__chunk", F.sum("__sum").over(earlier).alias("__before"))
    own = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = met(rows.withColumn("__own_sum", own), sums, [*key, "__chunk"])
    total = F.when(F.col("__before").isNull(), F.col("__own_sum")).otherwise(F.col("__before") + F.coalesce("__own_sum", F.lit(0)))
    return both.select(*df.columns, total.alias(into))


@dataclass(frozen=True)
class Tally:
    """A table's values counted by key and value, in range partitions of both."""

    key: tuple[str, ...]
    rows: DataFrame
    parts: DataFrame

    @classmethod
    def of(cls, df: DataFrame, key: Sequence[str], value: str) -> Tally:
        """Counts of value by key, nulls first; equal values are summed before they move."""
        counts = write_table(df.groupBy(*key, F.col(value).alias("value")).agg(F.count("*").alias("__c")), "counts")
        rows = spread(counts, key, ["value"])
        return cls(tuple(key), rows, write_table(_carried(rows, key, F.sum("__c")), "parts"))

    def sizes(self) -> DataFrame:
        """key and n."""
        return self.parts.groupBy(*self.key).agg(F.max("__total").alias("n"))

    def at(self, wanted: DataFrame) -> DataFrame:
        """wanted (key, rank from 0 in the key's sorted values, and more) with the value at the rank.

        A rank's partition is found from the partitions' counts; only such partitions are looked
        into, each on its own. Ranks that a key doesn't reach give no rows.
        """
        key = [*self.key]
        placed = met(wanted, self.parts.select(*key, "__part", "__before", "__own"), key).where("rank >= __before AND rank < __before + __own")
        placed = write_table(placed, "wanted")
        some = placed.select(*key, "__part").distinct()
        # a partition's rows of one key: as many as a range partition holds
        inner = F.sum("__c").over(Window.partitionBy(*key, "__part").orderBy("value"))
        rows = met(self.rows, some, [*key, "__part"]).withColumn("__to", inner)
        found = met(placed, rows.select(*key, "__part", "value", "__to", "__c"), [*key, "__part"])
        return found.where("rank - __before < __to AND rank - __before >= __to - __c").select(*wanted.columns, "value")
