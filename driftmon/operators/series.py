"""Per-window series: pairing similarity with quality, deltas, scaling.

A series is one key (project, model, range, mode ...) with one row per
window, so every window function here is partitioned by the key and sorts
at most the number of windows of that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_similarity_performance(sim: DataFrame, perf: DataFrame, keys=("project",),
                                period_col: str = "period") -> DataFrame:
    """Inner equi-join of the similarity series and the macro-F1 series on key and window."""
    return sim.join(perf, [*keys, period_col], "inner")


def period_deltas(df: DataFrame, cols, keys=("project",), order_col: str = "period",
                  suffix: str = "_delta") -> DataFrame:
    """Difference from the previous window of the same key; the first (and a null) is 0."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    for c in cols:
        df = df.withColumn(f"{c}{suffix}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    return df


def minmax_scale(df: DataFrame, cols, keys=("project",), suffix: str = "_normalized") -> DataFrame:
    """``(x - min) / (max - min)`` per key; a constant series becomes 0."""
    w = Window.partitionBy(*keys)
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        df = df.withColumn(f"{c}{suffix}", F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.col(c) - lo))
    return df


def zscore_scale(df: DataFrame, cols, keys=("project",), suffix: str = "_zscore") -> DataFrame:
    """``(x - mean) / population sd`` per key; a constant series becomes 0."""
    w = Window.partitionBy(*keys)
    for c in cols:
        mu, sd = F.avg(c).over(w), F.stddev_pop(c).over(w)
        df = df.withColumn(f"{c}{suffix}", F.coalesce(F.try_divide(F.col(c) - mu, F.nullif(sd, F.lit(0.0))),
                                                      F.col(c) - mu))
    return df


def stack_windows(frames) -> DataFrame:
    """Concatenate window frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
