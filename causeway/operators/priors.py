"""Priors of edge strength from graded adjectives. Randomness is hashed from keys: repeatable anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import normal, uniform, wrap_theta
from causeway.operators import scan

LOW, WIDTH = -math.pi / 2, math.pi
#: Added to each bin's count, so that no bin is impossible.
FLOOR = 1e-5


def silverman(df: DataFrame, key: Sequence[str], value: str = "response") -> DataFrame:
    """bw of each key: (4 sd^5 / 3 n)^0.2; 0 for one value."""
    return df.groupBy(*key).agg(F.coalesce(F.pow(4 * F.pow(F.stddev_samp(value), 5) / (3 * F.count(value)), 0.2), F.lit(0.0)).alias("bw"))


def smooth_resample(responses: DataFrame, n: int, bw: float | None = 1.0, seed: int = 0, key: Sequence[str] = ("adjective",)) -> DataFrame:
    """key, k (from 1) and response: n draws of each key, a point picked evenly plus bw times a normal.

    bw None takes Silverman's. A pick is a rank among the key's points in order, found by the counts
    of range partitions: no key's points are sorted or gathered in one task.
    """
    tally = scan.Tally.of(responses.where("response IS NOT NULL"), key, "response")
    draws = tally.sizes().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    picked = tally.at(draws.withColumn("rank", F.floor(uniform(*key, F.col("k"), seed=3 * seed) * F.col("n"))))
    if bw is None:
        picked = scan.met(picked, silverman(responses, key), key)
    width = F.col("bw") if bw is None else F.lit(bw)
    return picked.select(*key, "k", (F.col("value") + width * normal(*key, F.col("k"), seed=3 * seed + 1)).alias("response"))


def theta_samples(pairs: DataFrame) -> DataFrame:
    """theta of each pair of responses (x of the subject, y of the object) and polarities: atan of the slope."""
    y, x = F.col("y") * F.col("obj_pol"), F.col("x") * F.col("subj_pol")
    slope = F.try_divide(y, x)
    return pairs.withColumn("theta", F.when(x == 0, F.when(y == 0, F.lit(0.0)).otherwise(F.sign(y) * (math.pi / 2))).otherwise(F.atan(slope)))


def theta_bin(theta, bins: int):
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((theta - LOW) / (WIDTH / bins)).cast("int")))


def theta_log_prior(samples: DataFrame, key: Sequence[str], bins: int = 100) -> DataFrame:
    """log_prior of every bin of each key: log of its share of the samples, with FLOOR in each bin."""
    counts = samples.where("theta IS NOT NULL").groupBy(*key, theta_bin(F.col("theta"), bins).alias("bin")).agg(F.count("*").alias("c"))
    total = counts.groupBy(*key).agg(F.sum("c").alias("n"))
    full = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*key, "bin"], "left")
    return full.select(*key, "bin", F.log((F.coalesce("c", F.lit(0)) + FLOOR) / (F.col("n") + FLOOR * bins)).alias("log_prior"))


def theta_mode(prior: DataFrame, key: Sequence[str], bins: int = 100) -> DataFrame:
    """The centre of each key's fullest bin; of several the lowest."""
    best = prior.groupBy(*key).agg(F.max_by("bin", F.struct("log_prior", -F.col("bin"))).alias("bin"))
    return best.select(*key, (LOW + (F.col("bin") + 0.5) * (WIDTH / bins)).alias("mode"))


def theta_init(samples: DataFrame, key: Sequence[str], method: str, bins: int = 100, warm: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """theta of each key by zero, one, half, mean, median, mode, random or warm (a table with theta)."""
    keys = samples.select(*key).distinct()
    if method in ("zero", "one", "half"):
        return keys.withColumn("theta", F.lit({"zero": 0.0, "one": math.atan(1), "half": math.atan(0.5)}[method]))
    if method == "random":
        return keys.withColumn("theta", LOW + WIDTH * uniform(*key, seed=seed))
    if method == "mode":
        return theta_mode(theta_log_prior(samples, key, bins), key, bins).withColumnRenamed("mode", "theta")
    if method == "warm":
        return keys.join(warm.select(*key, "theta"), list(key), "left").select(*key, F.coalesce("theta", F.lit(0.0)).alias("theta"))
    return samples.groupBy(*key).agg((F.avg("theta") if method == "mean" else F.percentile("theta", 0.5)).alias("theta"))


def wrapped(df: DataFrame, theta: str = "theta") -> DataFrame:
    """theta folded into (-pi/2, pi/2], and out where it can't be."""
    folded = wrap_theta(F.col(theta))
    return df.withColumn("out", folded.isNull() & F.col(theta).isNotNull()).withColumn(theta, folded)


def theta_log_density(thetas: DataFrame, prior: DataFrame, key: Sequence[str], bins: int = 100) -> DataFrame:
    """log_prior of the bin that each theta falls in."""
    return thetas.withColumn("bin", theta_bin(F.col("theta"), bins)).join(prior, [*key, "bin"]).drop("bin")


def prior_draws(samples: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """draw (from 1) and theta for each key: n picks among its samples."""
    out = smooth_resample(samples.select(*key, F.col("theta").alias("response")), n, 0.0, seed, key)
    return out.select(F.col("k").alias("draw"), *key, F.col("response").alias("theta"))
