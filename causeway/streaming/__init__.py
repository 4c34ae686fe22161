"""Streaming forms of batch operators, for observations that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_observations(obs: DataFrame, time: str, key: Sequence[str], length: str, late: str, value: str = "value") -> DataFrame:
    """Mean, sample deviation and count by tumbling window, for a stream or a table.

    Rows later than `late` behind the newest time are dropped by a stream, whose state stays bounded.
    """
    timed = obs.withWatermark(time, late) if obs.isStreaming else obs
    found = timed.groupBy(F.window(time, length).alias("window"), *key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return found.select(F.col("window.start").alias("start"), *key, "mean", "sd", "n")
