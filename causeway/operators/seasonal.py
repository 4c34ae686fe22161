"""Fourier curves over seasonal bins, fitted for all series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fourier_terms(at: Column, period: int, k: int) -> list[Column]:
    """1 and, for each frequency w up to k, sin(lwb) and lw cos(lwb), with l = 2 pi / period."""
    base = 2 * math.pi / period
    out = [F.lit(1.0)]
    for w in range(1, k + 1):
        out += [F.sin(at * (base * w)), F.cos(at * (base * w)) * (base * w)]
    return out


def fourier_features(df: DataFrame, period: int, k: int, at: str = "bin") -> DataFrame:
    """df with columns x0 (1), x1 (sin), x2 (cos), ..."""
    return df.withColumns({f"x{i}": c for i, c in enumerate(fourier_terms(F.col(at), period, k))})


def fourier_fit(df: DataFrame, key: Sequence[str], period: int, k: int, at: str = "bin", value: str = "value") -> DataFrame:
    """coef (array<double>) of the least-squares curve of each series.

    Spark sums the products of terms and values; what comes to Python is one row for each series,
    whose small system is solved by least norm (at half the period the sine is 0 at every bin).
    """
    n = 2 * k + 1
    x = fourier_features(df.where(F.col(value).isNotNull()), period, k, at)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = x.groupBy(*key).agg(F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("gram"), F.array(*[F.sum(F.col(f"x{i}") * F.col(value)) for i in range(n)]).alias("moment"))

    def solve(frames):
        for rows in frames:
            out = []
            for gram, moment in zip(rows["gram"], rows["moment"], strict=True):
                a = np.zeros((n, n))
                for (i, j), s in zip(pairs, gram, strict=True):
                    a[i, j] = a[j, i] = s
                out.append(np.linalg.lstsq(a, np.array(moment), rcond=1e-10)[0].tolist())
            yield rows[list(key)].assign(coef=pd.Series(out, index=rows.index))

    return sums.mapInPandas(solve, sums.select(*key, F.col("moment").alias("coef")).schema)


def fourier_predict(fits: DataFrame, points: DataFrame, key: Sequence[str], period: int, k: int, at: str = "bin") -> DataFrame:
    """points with predicted: the sum of coefficients times terms."""
    joined = points.join(fits.select(*key, "coef"), list(key))
    return joined.withColumn("predicted", sum((F.get("coef", F.lit(i)) * t for i, t in enumerate(fourier_terms(F.col(at), period, k))), F.lit(0.0))).drop("coef")


def bin_rmse(predicted: DataFrame, key: Sequence[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Root mean squared error by bin, and over all bins."""
    e = F.pow(F.col("predicted") - F.col(value), 2)
    return predicted.groupBy(*key, "bin").agg(F.sqrt(F.avg(e)).alias("rmse")), predicted.groupBy(*key).agg(F.sqrt(F.avg(e)).alias("rmse"))


def select_components(errors: DataFrame, key: Sequence[str]) -> DataFrame:
    """The number of components k after which the error (k, rmse) first stops to fall; 0 without errors."""
    w = Window.partitionBy(*key).orderBy("k")
    falls = F.coalesce(F.col("rmse") < F.lag("rmse").over(w), F.col("k") == 0)
    run = errors.withColumn("__falls", falls).withColumn("__on", F.min(F.col("__falls")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("__on") & F.col("rmse").isNotNull(), F.col("k"))), F.lit(0)).alias("k"))


def fit_all(df: DataFrame, midpoints: DataFrame, key: Sequence[str], period: int, most: int) -> DataFrame:
    """key, k and rmse against midpoints (bin, midpoint) for every number of components up to `most`."""
    out = None
    for k in range(most + 1):
        fits = fourier_fit(df, key, period, k)
        at = midpoints.withColumn("at", F.col("bin") + 0.5)
        rmse = bin_rmse(fourier_predict(fits, at, key, period, k, "at"), key, "midpoint")[1].select(*key, F.lit(k).alias("k"), "rmse")
        out = rmse if out is None else out.union(rmse)
    return out


def naive_baseline(train: DataFrame, test: DataFrame, key: Sequence[str], median: bool = False, value: str = "value") -> DataFrame:
    """Error of predicting each bin's mean or median."""
    centre = (F.percentile(value, 0.5) if median else F.avg(value)).alias("predicted")
    return bin_rmse(test.join(train.groupBy(*key, "bin").agg(centre), [*key, "bin"]), key, value)[1]
