"""Aggregations over observations, statements, timings and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import scan

SERIES = ("concept", "indicator")


def sum_by_period(df: DataFrame, *extra: str, value: str = "value") -> DataFrame:
    """Sums by year, month and further columns."""
    return df.groupBy("year", "month", *extra).agg(F.sum(value).alias(value))


def month_end_rollup(df: DataFrame, date: str, key: Sequence[str], value: str = "value") -> DataFrame:
    """Daily values as sums dated at the month's end."""
    return df.groupBy(*key, F.last_day(date).alias("month_end")).agg(F.sum(value).alias(value))


def mean_by_market(df: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*key).agg(F.avg(value).alias(value))


def block_sums(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int, value: str = "value") -> DataFrame:
    """Sums of k consecutive rows of each key; the incomplete rest goes."""
    n = scan.numbered(df, key, order, "__at", "__n")
    full = n.where(F.col("__at") < k * F.floor(F.col("__n") / k))
    return full.groupBy(*key, F.floor(F.col("__at") / k).alias("block")).agg(F.sum(value).alias(value))


def obs_per_step(obs: DataFrame, key: Sequence[str] = SERIES) -> DataFrame:
    """Mean, sample deviation and number of the values at each step; nulls are skipped."""
    return obs.groupBy(*key, "step").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))


def scaling_factor(steps: DataFrame, method: str = "first", key: Sequence[str] = SERIES) -> DataFrame:
    """scale and sd of each series from obs_per_step(): a representative mean (0 becomes 0.0001), and
    the largest deviation of a step (1 without any). method: first, last, min, max, mean, median."""
    scale = {"first": F.min_by("mean", "step"), "last": F.max_by("mean", "step"), "min": F.min("mean"), "max": F.max("mean"), "mean": F.avg("mean"), "median": F.percentile("mean", 0.5)}[method]
    found = steps.where("mean IS NOT NULL").groupBy(*key).agg(scale.alias("scale"), F.max("sd").alias("sd"))
    return found.select(*key, F.when(F.col("scale") == 0, 0.0001).otherwise(F.col("scale")).alias("scale"), F.coalesce("sd", F.lit(1.0)).alias("sd"))


def concept_moments(steps: DataFrame, scales: DataFrame, key: Sequence[str] = SERIES) -> DataFrame:
    """Mean and deviation of the scaled step means of a concept."""
    scaled = steps.select(*key, "mean").join(scales.select(*key, "scale"), list(key))
    return scaled.groupBy(key[0]).agg(F.avg(F.col("mean") / F.col("scale")).alias("mean"), F.stddev_samp(F.col("mean") / F.col("scale")).alias("sd"))


def scaled_bounds(scales: DataFrame, low: Column, high: Column) -> DataFrame:
    """Bounds in units of the scale, swapped where it is negative."""
    a, b, up = low / F.col("scale"), high / F.col("scale"), F.col("scale") > 0
    return scales.withColumns({"low": F.when(up, a).otherwise(b), "high": F.when(up, b).otherwise(a)})


def modal_gap(obs: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """Shortest, longest and most frequent gap (of two, the smaller) of distinct time points, and its count."""
    counts = scan.gaps(obs, key, time).groupBy(*key, "gap").agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.max_by("gap", F.struct("n", -F.col("gap"))).alias("gap"), F.max("n").alias("n"))


def infer_period(obs: DataFrame, key: Sequence[str], ms: str) -> DataFrame:
    """Observations in a year of each series, by the shortest gap in days.

    365 for 1 day, 52 for 7, 12 for 28 to 31, 6 for 59 to 62, 4 for 89 to 92, 3 for 120 to 123, 2
    for 181 to 184, and 1 for any other gap, or none.
    """
    day = F.floor(F.col(ms) / 86_400_000)
    days = obs.select(*key, day.alias("__d")).distinct().withColumn("__gap", F.col("__d") - F.lag("__d").over(Window.partitionBy(*key).orderBy("__d")))
    least = days.groupBy(*key).agg(F.min("__gap").alias("gap"))
    g = F.col("gap")
    period = F.when(g == 1, 365).when(g == 7, 52)
    for low, times in ((28, 12), (59, 6), (89, 4), (120, 3), (181, 2)):  # spans of one to six months, by days
        period = period.when(g.between(low, low + 3), times)
    period = period.otherwise(1)
    return least.select(*key, "gap", period.alias("period"))


def common_period(periods: DataFrame) -> DataFrame:
    """The least common multiple of the periods (a column `period` of few distinct values)."""

    def gcd(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("x"), b.alias("y"))
        turn = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, turn, lambda s: s["x"])

    values = periods.agg(F.collect_set(F.col("period").cast("long")).alias("p"))
    return values.select(F.aggregate("p", F.lit(1).cast("long"), lambda t, p: (t * p / gcd(t, p)).cast("long")).alias("period"))


def train_window(obs: DataFrame, time: str) -> DataFrame:
    return obs.agg(F.min(time).alias("start"), F.max(time).alias("end"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of each node; inputs have none in, outputs none out."""
    ends = edges.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    d = ends.groupBy("name").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return d.withColumns({"degree": F.col("n_in") + F.col("n_out"), "is_input": F.col("n_in") == 0, "is_output": F.col("n_out") == 0})


def head_body_split(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name and is_head: whether no edge leads to the node."""
    into = edges.select(F.col("dst").alias("name"), F.lit(True).alias("__in")).distinct()
    return nodes.join(into, "name", "left").select("name", F.col("__in").isNull().alias("is_head"))


#: Items in a part of a list.
PART = 4096


def edge_evidence(evidence: DataFrame, fields: Sequence[str], size: int = PART) -> DataFrame:
    """subj, obj, n (pieces of the pair), part and evidence: the pieces of each pair of different concepts
    in order of stmt, evid, up to `size` in a part, so that a hub's list is never one row."""
    columns = ["stmt", "evid", *fields]
    return scan.chunked(evidence.where("subj <> obj"), ["subj", "obj"], columns, columns, size, "evidence")


def edge_reinforcement(evidence: DataFrame) -> DataFrame:
    """The mean of subject polarity times object polarity."""
    return evidence.where("subj <> obj").groupBy("subj", "obj").agg(F.avg(F.col("subj_pol") * F.col("obj_pol")).alias("reinforcement"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """Adjectives and polarities of each edge's first piece."""
    fields = ("subj_adj", "obj_adj", "subj_pol", "obj_pol")
    first = evidence.where("subj <> obj").groupBy("subj", "obj").agg(F.min_by(F.struct(*fields), F.struct("stmt", "evid", *fields)).alias("e"))
    return first.select("subj", "obj", "e.*")


def filter_funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows that pass the first, the first two, ... filters, in one pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("all")]
    for name, test in stages.items():
        passed = passed & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return df.agg(*aggs)


def _roles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("role", "adjectives"))


def adjective_multiplicity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows by role and number of adjectives."""
    return _roles(df, columns).groupBy("role", F.size(F.coalesce("adjectives", F.array().cast("array<string>"))).alias("size")).agg(F.count("*").alias("n"))


def _or_none(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(F.size(c), F.lit(0)) < 1, F.array(F.lit("None"))).otherwise(c)


def adjective_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Uses of each adjective by role; an empty list counts as 'None'."""
    return _roles(df, columns).select("role", F.explode(_or_none("adjectives")).alias("adjective")).groupBy("role", "adjective").agg(F.count("*").alias("n"))


def adjective_pairs(df: DataFrame, subj: str, obj: str) -> DataFrame:
    """Uses of each pair of a subject's and an object's adjective."""
    pairs = df.select(F.explode(_or_none(subj)).alias("subj_adj"), obj).select("subj_adj", F.explode(_or_none(obj)).alias("obj_adj"))
    return pairs.groupBy("subj_adj", "obj_adj").agg(F.count("*").alias("n"))


def grounding_inventory(df: DataFrame, grounding: str, text: str, size: int = PART) -> DataFrame:
    """leaf (each grounding's last path part), n, part and texts: its distinct texts in order, up to `size` in a part."""
    rows = df.select(F.substring_index(grounding, "/", -1).alias("leaf"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    return scan.chunked(rows, ["leaf"], ["text"], ["text"], size, "texts").withColumn("texts", F.transform("texts", lambda t: t["text"]))


def inspection_table(evidence: DataFrame, key: Sequence[str]) -> DataFrame:
    return evidence.groupBy(*key).agg(F.avg("subj_pol").alias("subj_pol"), F.avg("obj_pol").alias("obj_pol"))


def timing_summary(timings: DataFrame, key: Sequence[str] = ("nodes", "edges", "kind"), digits: int = 4) -> DataFrame:
    """Mean, median, deviation and count of wall and CPU time."""
    aggs = [F.count("*").alias("n")]
    for c in ("wall", "cpu"):
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.percentile(c, 0.5), digits).alias(f"{c}_median"), F.round(F.stddev_samp(c), digits).alias(f"{c}_sd")]
    return timings.groupBy(*key).agg(*aggs)


def speedup(both: DataFrame, before: str, after: str) -> DataFrame:
    """Difference, percentage and factor of two measures."""
    b, a = F.col(before), F.col(after)
    return both.withColumns({"diff": b - a, "percent": F.try_divide((b - a) * 100, b), "fold": F.try_divide(b, a)})


def mean_by_kind(df: DataFrame, key: Sequence[str], kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """A column of means for each kind."""
    return df.groupBy(*key).agg(*[F.avg(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])


def regression_diff(before: DataFrame, after: DataFrame, on: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Frequency of the differences of two snapshots, and their mean and deviation."""
    both = before.select(*on, F.col(value).alias("__b")).join(after.select(*on, F.col(value).alias("__a")), list(on)).withColumn("diff", F.col("__a") - F.col("__b"))
    return both.groupBy("diff").agg(F.count("*").alias("n")), both.agg(F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))


def coincident_counts(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal-width bin (from 0) of values within the bounds; the right edge is in the last bin."""
    inside = df.where(F.col(value).between(low, high))
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def value_frequency(df: DataFrame, key: Sequence[str], value: str, digits: int = 0) -> DataFrame:
    return df.groupBy(*key, F.round(value, digits).alias("rounded")).agg(F.count("*").alias("n"))


def percentile_conditional(df: DataFrame, condition: str, p: float, within: Column | None = None, select_within: bool = False) -> DataFrame:
    """Rows whose condition lies below its p-th percentile. The filter `within` counts for the
    percentile, and for the rows only with select_within."""
    base = df if within is None else df.where(within)
    bound = base.agg(F.percentile(condition, p).alias("__bound"))
    rows = base if select_within else df
    return rows.join(F.broadcast(bound), F.col(condition) < F.col("__bound")).drop("__bound")  # one row


def expected_distribution(df: DataFrame, value: str, low: float, high: float, unit: str) -> DataFrame:
    """Values within the bounds; more than one unit among them fails."""
    rows = df.where(F.col(value).between(low, high))
    units = rows.select(unit).distinct().limit(2).count()
    if units > 1:
        raise ValueError("the values have more than one unit")
    return rows


def month_regression(df: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """For each calendar month, the line over years, and the line of the next month's value on this one's.

    df has one row for each key, year and month.
    """
    w = Window.partitionBy(*key).orderBy(F.col("year") * 12 + F.col("month"))
    nxt = F.when(F.lead(F.col("year") * 12 + F.col("month")).over(w) == F.col("year") * 12 + F.col("month") + 1, F.lead(value).over(w))
    both = df.withColumn("__next", nxt)
    return both.groupBy(*key, "month").agg(F.regr_slope(value, "year").alias("slope"), F.regr_intercept(value, "year").alias("intercept"), F.regr_slope("__next", value).alias("next_slope"), F.regr_intercept("__next", value).alias("next_intercept"))


def month_moments(df: DataFrame, key: Sequence[str], position: str, value: str = "value") -> DataFrame:
    """Mean and population deviation for each calendar position."""
    return df.groupBy(*key, position).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
