"""Sensitivity of evaluated outputs: designs, indices, resampled intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import uniform


def clean_bounds(bounds: Mapping[str, Sequence[float]]) -> dict[str, tuple[float, float]]:
    """Bounds as pairs; malformed ones count as 0 to 1; none at all fails."""
    if not bounds:
        raise ValueError("no bounds")
    return {k: (float(b[0]), float(b[1])) if len(b) == 2 and b[0] < b[1] else (0.0, 1.0) for k, b in bounds.items()}


def design_table(ids: DataFrame, bounds: Mapping[str, Sequence[float]], seed: int = 0, categories: Sequence[str] = ()) -> DataFrame:
    """id, block and a column for each variable, for each row of ids (id): blocks A, B, and for each variable A with B's value of it.

    Values are hashed from row and variable. A category is 0 or 1, by half of its bounds.
    """
    clean = clean_bounds(bounds)

    def value(name: str, k: int, matrix: str):
        lo, hi = clean[name]
        u = uniform(F.col("id"), F.lit(name), F.lit(matrix), seed=seed)
        return F.when(u < 0.5, 0.0).otherwise(1.0) if name in categories else lo + (hi - lo) * u

    names = list(clean)
    blocks = F.explode(F.array(F.lit("A"), F.lit("B"), *[F.lit(f"A_{v}") for v in names])).alias("block")
    rows = ids.select("id", blocks)
    return rows.select("id", "block", *[F.when((F.col("block") == "B") | (F.col("block") == f"A_{v}"), value(v, k, "B")).otherwise(value(v, k, "A")).alias(v) for k, v in enumerate(names)])


def sobol_indices(outputs: DataFrame, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """variable, s1 and st from outputs (id, block, y), one row for each id and block, by key columns `extra`."""
    wide = outputs.groupBy(*extra, "id").pivot("block", ["A", "B", *[f"A_{v}" for v in names]]).agg(F.first("y"))
    both = wide.select(*extra, F.explode(F.array("A", "B")).alias("y")).groupBy(*extra).agg(F.var_pop("y").alias("__var"))
    first = [F.avg(F.col("B") * (F.col(f"A_{v}") - F.col("A"))).alias(f"__s_{v}") for v in names]
    total = [F.avg(F.pow(F.col("A") - F.col(f"A_{v}"), 2)).alias(f"__t_{v}") for v in names]
    sums = wide.groupBy(*extra).agg(*first, *total)
    joined = sums.join(both, list(extra)) if extra else sums.crossJoin(F.broadcast(both))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.try_divide(F.col(f"__s_{v}"), F.col("__var")).alias("s1"), F.try_divide(F.col(f"__t_{v}") / 2, F.col("__var")).alias("st")) for v in names])).alias("r")
    return joined.select(*extra, rows).select(*extra, "r.*")


def second_order(outputs: DataFrame, names: Sequence[str]) -> DataFrame:
    """i, j and s2 from outputs that hold blocks B_v too (B with A's value of v)."""
    wide = outputs.groupBy("id").pivot("block", ["A", "B", *[f"A_{v}" for v in names], *[f"B_{v}" for v in names]]).agg(F.first("y"))
    both = wide.select(F.explode(F.array("A", "B")).alias("y")).agg(F.var_pop("y").alias("__var"))
    s1 = sobol_indices(outputs, names).select("variable", "s1")
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    v2 = wide.agg(*[F.avg(F.col(f"B_{a}") * F.col(f"A_{b}") - F.col("A") * F.col("B")).alias(f"__{a}_{b}") for a, b in pairs]).crossJoin(F.broadcast(both))  # one row each
    rows = v2.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.try_divide(F.col(f"__{a}_{b}"), F.col("__var")).alias("v")) for a, b in pairs])).alias("r")).select("r.*")
    one, two = s1.select(F.col("variable").alias("i"), F.col("s1").alias("__a")), s1.select(F.col("variable").alias("j"), F.col("s1").alias("__b"))
    return rows.join(one, "i").join(two, "j").select("i", "j", (F.col("v") - F.col("__a") - F.col("__b")).alias("s2"))


def poisson_steps() -> list[float]:
    """The chances that a Poisson number of mean 1 is at most 0, 1, 2, ..., as far as doubles tell them from 1."""
    steps, term, total = [], math.exp(-1), 0.0
    while total + term > total:
        total += term
        steps.append(total)
        term /= len(steps)
    return [s for s in steps if s < 1]


def index_confidence(outputs: DataFrame, names: Sequence[str], repeats: int = 100, seed: int = 0) -> DataFrame:
    """variable, s1_conf and st_conf: 1.96 deviations of the indices over resamples of ids.

    An id counts in each repeat as often as a Poisson number of mean 1, hashed from both, tells. Weights
    enter the sums (of w, w y, w y y, ...) instead of copies of rows, and each task passes on one
    row of sums for each repeat.
    """
    wide = outputs.groupBy("id").pivot("block", ["A", "B", *[f"A_{v}" for v in names]]).agg(F.first("y"))
    u = uniform(F.col("id"), F.col("rep"), seed=seed)
    weight = reduce(lambda a, b: a + b, [F.when(u > c, 1).otherwise(0) for c in poisson_steps()])
    rows = wide.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("w", weight)
    w, a, b = F.col("w"), F.col("A"), F.col("B")
    first = [F.sum(w * b * (F.col(f"A_{v}") - a)).alias(f"__s_{v}") for v in names]
    total = [F.sum(w * F.pow(a - F.col(f"A_{v}"), 2)).alias(f"__t_{v}") for v in names]
    sums = rows.groupBy("rep").agg(F.sum("w").alias("__n"), F.sum(w * (a + b)).alias("__y"), F.sum(w * (a * a + b * b)).alias("__yy"), *first, *total)
    variance = F.col("__yy") / (2 * F.col("__n")) - F.pow(F.col("__y") / (2 * F.col("__n")), 2)
    indices = [F.struct(F.lit(v).alias("variable"), F.try_divide(F.col(f"__s_{v}") / F.col("__n"), F.col("__var")).alias("s1"), F.try_divide(F.col(f"__t_{v}") / F.col("__n") / 2, F.col("__var")).alias("st")) for v in names]
    each = sums.withColumn("__var", variance).select(F.explode(F.array(*indices)).alias("r")).select("r.*")
    return each.groupBy("variable").agg((1.96 * F.stddev_samp("s1")).alias("s1_conf"), (1.96 * F.stddev_samp("st")).alias("st_conf"))


def s2_extremes(s2: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The least and the largest s2 with their pairs."""
    grouped = s2.groupBy(*key)
    return grouped.agg(F.min("s2").alias("s2_min"), F.min_by(F.struct("i", "j"), F.struct("s2", "i", "j")).alias("__l"), F.max("s2").alias("s2_max"), F.max_by(F.struct("i", "j"), F.struct("s2", "i", "j")).alias("__h")).select(*key, "s2_min", F.col("__l.i").alias("min_i"), F.col("__l.j").alias("min_j"), "s2_max", F.col("__h.i").alias("max_i"), F.col("__h.j").alias("max_j"))


def index_convergence(outputs: DataFrame, names: Sequence[str], sizes: DataFrame) -> DataFrame:
    """size, variable, s1 and st of the ids below each size (a table of one column, size: a few rows)."""
    rows = outputs.join(sizes, F.col("id") < F.col("size"))
    return sobol_indices(rows, names, ["size"])
