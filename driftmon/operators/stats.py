"""Correlation and histogram operators over many series at once.

Coefficients, ranks, scaling and histograms are SQL aggregates and window
functions.  Only the p-values, which have no SQL form, run in Python (a
scalar pandas UDF over ``(r, n)`` columns).  Normality is in
:mod:`driftmon.operators.normality`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from driftmon.functions import numeric as K
from driftmon.functions.periods import period_year
from driftmon.operators.joins import join_small
from driftmon.operators.normality import ALPHA, check_normality, qq_points  # noqa: F401
from driftmon.operators.quantiles import ordered_values, with_quantiles
from driftmon.sources.scratch import written


@pandas_udf(DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation coefficient (Student t with n-2 df)."""
    out = [K.correlation_p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
           for a, b in zip(r, n)]
    return pd.Series([np.nan if v is None else v for v in out], dtype="float64")


def pearson_r(x: str, y: str) -> Column:
    """Pearson r as an aggregate; null for a constant series (no division error under ANSI)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(col: str, keys) -> Column:
    """Rank with ties sharing the average of their positions (1-based)."""
    w = Window.partitionBy(*keys).orderBy(col)
    ties = Window.partitionBy(*keys, col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def pearson(df: DataFrame, x: str, y: str, keys=("project",), with_p: bool = True) -> DataFrame:
    """Per key: ``n``, ``r`` (and two-sided ``p``)."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson_r(x, y).alias("r"))
    return out.withColumn("p", correlation_p_udf("r", "n")) if with_p else out


def spearman(df: DataFrame, x: str, y: str, keys=("project",), with_p: bool = True) -> DataFrame:
    """Spearman rho = Pearson r of average ranks, per key."""
    keys = list(keys)
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = clean.select(*keys, average_rank(x, keys).alias("_rx"), average_rank(y, keys).alias("_ry"))
    return pearson(ranked, "_rx", "_ry", keys, with_p)


def density_histogram(df: DataFrame, col: str, keys=("project",)) -> DataFrame:
    """Density histogram per key with the automatic bin rule, exact quartiles from one range sort.

    width = min(max(Freedman-Diaconis, sqrt-rule / 2), Sturges); bins =
    ceil(range / width) (1 if the width is 0); equal bins over [min, max],
    the last bin closed; density = count / (n x bin width).
    """
    keys = list(keys)
    v = ordered_values(df.where(F.col(col).isNotNull()), keys, col)
    st = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    st = with_quantiles(st, v, keys, {"q1": 0.25, "q3": 0.75})
    v = v.drop("at")
    span = F.col("hi") - F.col("lo")
    fd = 2.0 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n"), -1.0 / 3.0)
    sturges = span / (F.log2(F.col("n")) + 1.0)
    sqrt_rule = span / F.sqrt(F.col("n"))
    width = F.least(F.greatest(fd, sqrt_rule / 2.0), sturges)
    st = st.withColumn("bins", F.when(width > 0, F.ceil(span / width)).otherwise(F.lit(1)).cast("int"))
    st = (st.withColumn("first", F.when(span == 0, F.col("lo") - 0.5).otherwise(F.col("lo")))
          .withColumn("last", F.when(span == 0, F.col("hi") + 0.5).otherwise(F.col("hi"))))
    st = st.select(*keys, "n", "bins", "first", "last")
    j = join_small(v, st, keys, "inner")
    idx = F.floor((F.col("v") - F.col("first")) * F.col("bins") / (F.col("last") - F.col("first"))).cast("int")
    j = j.withColumn("bin", F.least(idx, F.col("bins") - 1))
    counts = j.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    all_bins = st.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    out = all_bins.join(counts, [*keys, "bin"], "left").fillna(0, ["count"])
    bw = (F.col("last") - F.col("first")) / F.col("bins")
    return out.select(
        *keys, "bin",
        (F.col("first") + F.col("bin") * bw).alias("bin_left"),
        (F.col("first") + (F.col("bin") + 1) * bw).alias("bin_right"),
        F.col("count").cast("bigint").alias("count"),
        (F.col("count") / (F.col("n") * bw)).alias("density"),
    )


def _choose_method(norm: DataFrame, keys, x: str, y: str) -> DataFrame:
    flags = norm.groupBy(*keys).agg(
        F.max(F.when(F.col("variable") == x, F.col("is_normal"))).alias("x_normal"),
        F.max(F.when(F.col("variable") == y, F.col("is_normal"))).alias("y_normal"),
    )
    return flags.withColumn("test_method", F.when(F.col("x_normal") & F.col("y_normal"), "Pearson")
                            .otherwise("Spearman"))


def auto_correlation_test(df: DataFrame, x: str, y: str, keys=("project",), alpha: float = ALPHA) -> DataFrame:
    """Pearson when both series pass Shapiro-Wilk, else Spearman; r, p, n, significance.

    The paired series are written once; the tests and both coefficients read them.
    """
    keys = list(keys)
    df = written(df.select(*keys, x, y), "paired-series")
    method = _choose_method(check_normality(df, [x, y], keys, alpha), keys, x, y)
    p = pearson(df, x, y, keys).select(*keys, "n", F.col("r").alias("r_p"), F.col("p").alias("p_p"))
    s = spearman(df, x, y, keys).select(*keys, F.col("r").alias("r_s"), F.col("p").alias("p_p_s"))
    out = method.join(p, keys).join(s, keys)
    pear = F.col("test_method") == "Pearson"
    out = out.select(
        *keys, "test_method",
        F.when(pear, F.col("r_p")).otherwise(F.col("r_s")).alias("correlation_coefficient"),
        F.when(pear, F.col("p_p")).otherwise(F.col("p_p_s")).alias("p_value"),
        F.col("n").alias("sample_size"),
    )
    return out.withColumn("is_significant", F.col("p_value") < alpha).withColumn("significance_level", F.lit(alpha))


def yearly_correlation(df: DataFrame, x: str, y: str, keys=("project",), period_col: str = "period",
                       min_points: int = 3, alpha: float = ALPHA) -> DataFrame:
    """The automatic test per key and calendar year; years with < ``min_points`` are skipped."""
    keys = list(keys)
    yearly = df.withColumn("year", period_year(period_col))
    of_year = Window.partitionBy(*keys, "year")
    kept = yearly.withColumn("_n", F.count(F.lit(1)).over(of_year)).where(F.col("_n") >= min_points).drop("_n")
    return auto_correlation_test(kept, x, y, [*keys, "year"], alpha)
