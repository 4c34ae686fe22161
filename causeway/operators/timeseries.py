"""Time axes, steps, seasons and fills of indicator series. Long tables throughout; no dense arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import month_index, steps_between
from causeway.operators import scan


def epoch_to_ymd(ms: Column) -> dict[str, Column]:
    """year, month, day (UTC) and late (day after the first) of milliseconds."""
    t = F.timestamp_millis(ms)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "late": F.dayofmonth(t) > 1}


def align_to_steps(obs: DataFrame, ms: str = "ts_ms", level: str = "MONTHLY") -> DataFrame:
    """obs with step: months or years since the first observation of all series."""
    first = obs.agg(F.timestamp_millis(F.min(ms)).alias("__first"))
    return obs.crossJoin(F.broadcast(first)).withColumn("step", steps_between(F.col("__first"), F.timestamp_millis(ms), level)).drop("__first")  # one row


def step_gaps(df: DataFrame, key: Sequence[str], step: str = "step") -> DataFrame:
    """Difference of successive distinct steps of each series."""
    return scan.gaps(df, key, step)


def month_axis(spark, start: str, end: str) -> DataFrame:
    """month (date), step (months since year 0) and label (year-month, unpadded) of a range."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}', 'MM'), trunc(date'{end}', 'MM'), interval 1 month)")).alias("month"))
    return days.select("month", month_index(F.year("month"), F.month("month")).alias("step"), F.concat_ws("-", F.year("month"), F.month("month")).alias("label"))


def monthly_means(df: DataFrame, axis: DataFrame, key: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """Mean of each month of the axis, null for gaps."""
    full = df.select(*key).distinct().crossJoin(axis.select(step))
    means = df.groupBy(*key, step).agg(F.avg(value).alias(value))
    return full.join(means, [*key, step], "left")


@lru_cache(maxsize=4096)
def t_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's distribution, by bisection over Simpson sums of its density."""
    from math import lgamma, pi, sqrt, tan

    c = np.exp(lgamma((freedom + 1) / 2) - lgamma(freedom / 2)) / sqrt(freedom * pi)
    lo, hi = 0.0, 1.0  # of 2/pi * atan(t / sqrt(freedom)), so that the tail is finite

    def below(u: float) -> float:
        a = np.linspace(0, u * pi / 2, 2001)
        y = c * np.cos(a) ** (freedom - 1) * sqrt(freedom)
        w = np.ones(2001)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return 0.5 + float((w * y).sum() * (a[1] - a[0]) / 3)

    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return sqrt(freedom) * tan((lo + hi) / 2 * pi / 2)


#: Sample sizes up to which Student's quantile is integrated; beyond, four terms of its expansion about the
#: normal one give it to nine digits.
T_TABLE = 200


def expansion(z: float) -> list[float]:
    """Student's quantile as a polynomial of 1 / (degrees of freedom), from the normal one."""
    return [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]


def _expanded(z: float, freedom: Column) -> Column:
    out = F.lit(0.0)
    for term in reversed(expansion(z)):
        out = out / freedom + term
    return out


def mean_with_ci(df: DataFrame, key: Sequence[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """mean, lower and upper of the mean's interval; no bounds for one value, all null for none."""
    stats = df.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"), F.count(value).alias("__n"))
    p = (1 + level) / 2
    table = F.array(*[F.lit(t_quantile(p, n)) for n in range(1, T_TABLE)])
    z = NormalDist().inv_cdf(p)
    t = F.when(F.col("__n") < 2, None).when(F.col("__n") <= T_TABLE, F.element_at(table, F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.lit(T_TABLE - 1))).cast("int"))).otherwise(_expanded(z, F.col("__n") - 1))
    half = t * F.col("__sd") / F.sqrt("__n")
    return stats.select(*key, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def season_bin(df: DataFrame, period: int, step: str = "step") -> DataFrame:
    return df.withColumn("bin", F.pmod(F.col(step), F.lit(period)).cast("int"))


def season_profile(df: DataFrame, key: Sequence[str], measure: str = "mean", value: str = "value") -> DataFrame:
    """centre and spread of each bin: mean and deviation, or median and median absolute deviation; one value spreads 0."""
    if measure == "mean":
        return df.groupBy(*key, "bin").agg(F.avg(value).alias("centre"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"))
    centre = df.groupBy(*key, "bin").agg(F.percentile(value, 0.5).alias("centre"))
    return df.join(centre, [*key, "bin"]).groupBy(*key, "bin").agg(F.first("centre").alias("centre"), F.percentile(F.abs(F.col(value) - F.col("centre")), 0.5).alias("spread"))


def circular_interpolate(profile: DataFrame, key: Sequence[str], period: int, value: str = "centre") -> DataFrame:
    """Every bin of the period; empty ones lie on the line between their neighbours around the circle."""
    bins = profile.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    full = bins.join(profile.select(*key, "bin", value), [*key, "bin"], "left")
    turn = full.withColumn("at", F.explode(F.array(F.col("bin") - period, F.col("bin"), F.col("bin") + period)))
    w = Window.partitionBy(*key).orderBy("at")
    known = F.when(F.col(value).isNotNull(), F.struct("at", F.col(value).alias("v")))
    before, after = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = turn.withColumns({"__b": before, "__a": after}).where(F.col("at") == F.col("bin"))
    line = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * (F.col("at") - F.col("__b.at")) / F.when(F.col("__a.at") > F.col("__b.at"), F.col("__a.at") - F.col("__b.at")).otherwise(1)
    return both.select(*key, "bin", line.alias(value))


def season_changes(profile: DataFrame, key: Sequence[str], period: int, relative: bool = False, value: str = "centre") -> DataFrame:
    """Change from each bin to the next around the circle; relative: over the start plus 1."""
    nxt = profile.select(*key, F.pmod(F.col("bin") - 1, F.lit(period)).cast("int").alias("bin"), F.col(value).alias("__next"))
    change = F.col("__next") - F.col(value)
    return profile.join(nxt, [*key, "bin"]).select(*key, "bin", (change / (F.col(value) + 1) if relative else change).alias("change"))


def season_sequence(profile: DataFrame, key: Sequence[str], period: int, steps: int, model: str = "centre", low: float | None = None, high: float | None = None) -> DataFrame:
    """Expected value of each step from 0: the bin's centre, or the first centre moved on by absolute or
    relative changes; then clipped."""
    axis = profile.select(*key).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("bin", F.pmod("step", F.lit(period)).cast("int"))
    if model == "centre":
        out = axis.join(profile, [*key, "bin"]).select(*key, "step", F.col("centre").alias("value"))
    else:
        changes = season_changes(profile, key, period, model == "relative")
        start = profile.where("bin = 0").select(*key, F.col("centre").alias("__start"))
        last = axis.withColumn("bin", F.pmod(F.col("step") - 1, F.lit(period)).cast("int")).join(changes, [*key, "bin"]).join(start, list(key))
        w = Window.partitionBy(*key).orderBy("step")
        move = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(F.col("change"))
        if model == "absolute":
            value = F.col("__start") + F.sum(move).over(w)
            out = last.select(*key, "step", value.alias("value"))
        else:
            # x -> x + (x + 1) * change, folded over the ordered moves; the axis bounds their number.
            moves = last.groupBy(*key).agg(F.first("__start").alias("__start"), F.array_sort(F.collect_list(F.struct("step", move.alias("m")))).alias("moves"))
            grow = lambda x, m: x + (x + 1) * m["m"]
            each = moves.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
            out = each.select(*key, "step", F.aggregate(F.slice("moves", F.lit(1), F.col("step") + 1), F.col("__start"), grow).alias("value"))
    for bound, clip in ((low, F.greatest), (high, F.least)):
        if bound is not None:
            out = out.withColumn("value", clip("value", F.lit(bound)))
    return out


def period_changes(df: DataFrame, key: Sequence[str], period: int, median: bool = False, value: str = "value") -> DataFrame:
    """Changes from the step before, by the earlier step's bin, as mean or median."""
    w = Window.partitionBy(*key).orderBy("step")
    change = df.select(*key, F.pmod(F.lag("step").over(w), F.lit(period)).cast("int").alias("bin"), (F.col(value) - F.lag(value).over(w)).alias("change")).where("bin IS NOT NULL")
    return change.groupBy(*key, "bin").agg((F.percentile("change", 0.5) if median else F.avg("change")).alias("change"))


def relative_change(df: DataFrame, key: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """(next - this) / this, null where this is 0."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("change", (F.lead(value).over(w) - F.col(value)) / F.nullif(F.col(value), F.lit(0)))


def midpoints(df: DataFrame, key: Sequence[str], period: int, value: str = "value") -> DataFrame:
    """Means of neighbouring steps where they are consecutive, with the earlier one's bin."""
    w = Window.partitionBy(*key).orderBy("step")
    mid = F.when(F.lead("step").over(w) == F.col("step") + 1, (F.col(value) + F.lead(value).over(w)) / 2)
    return df.select(*key, F.pmod("step", F.lit(period)).cast("int").alias("bin"), mid.alias("midpoint")).where("midpoint IS NOT NULL")


def year_month_matrix(df: DataFrame, value: str = "value") -> DataFrame:
    """A row for each year with a column of means for each month."""
    return df.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg(value)).withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def fill_months(df: DataFrame, axis: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Each series on the axis (year, month): the month's mean, else the year's, else the series'."""
    month = df.groupBy(*key, "year", "month").agg(F.avg(value).alias("__m"))
    year = df.groupBy(*key, "year").agg(F.avg(value).alias("__y"))
    total = df.groupBy(*key).agg(F.avg(value).alias("__t"))
    full = total.crossJoin(axis.select("year", "month"))
    return full.join(month, [*key, "year", "month"], "left").join(year, [*key, "year"], "left").select(*key, "year", "month", F.coalesce("__m", "__y", "__t").alias(value))


def percent_deltas(filled: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Successive fractional change: 0 to 0 is 0; from 0 to another value, plus or minus the absolute
    mean of the series' finite changes."""
    w = Window.partitionBy(*key).orderBy("year", "month")
    nxt = F.lead(value).over(w)
    delta = F.when((F.col(value) == 0) & (nxt == 0), 0.0).when(F.col(value) != 0, (nxt - F.col(value)) / F.nullif(F.col(value), F.lit(0.0)))
    rows = filled.select(*key, "year", "month", delta.alias("__d"), F.sign(nxt).alias("__s"), nxt.isNotNull().alias("__has")).where("__has")
    mean = rows.groupBy(*key).agg(F.abs(F.avg("__d")).alias("__mean"))
    return rows.join(mean, list(key)).select(*key, "year", "month", F.coalesce("__d", F.col("__s") * F.col("__mean")).alias("delta"))


def split_by_periods(df: DataFrame, key: Sequence[str], order: str, train: int = 32, validate: int = 20) -> DataFrame:
    """part: train for the first periods of each series, validate for the next, test for the rest."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("part", F.when(rn <= train, "train").when(rn <= train + validate, "validate").otherwise("test"))


def plateau(df: DataFrame, key: Sequence[str], order: str, n: int, delta: float, value: str = "value") -> DataFrame:
    """The first row of each series before which n values lie within delta of each other."""
    rows, w = scan.neighbourly(df, key, [order], before=n)
    back = w.rowsBetween(-n, -1)
    marked = rows.withColumn("__flat", (F.col("index") >= n) & (F.max(value).over(back) - F.min(value).over(back) <= delta))
    return marked.where("__own AND __flat").groupBy(*key).agg(F.min(order).alias(order))
