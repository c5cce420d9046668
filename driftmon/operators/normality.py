"""Normality tests and probability plots of many series, from ranks over one range sort.

Shapiro-Wilk's W, Anderson-Darling's A2 and the plot's line are sums over the
ordered values, each weighted by its place.  A range sort gives the places
(:func:`driftmon.operators.quantiles.ranked_values`), scalar pandas UDFs the
normal quantiles and tail logarithms value by value, and partial aggregates
the sums.  A series may be of any length and hold any share of the rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from driftmon.functions import numeric as K
from driftmon.operators.joins import join_small
from driftmon.operators.quantiles import ordered_values, ranked_values
from driftmon.sources.scratch import written

ALPHA = 0.05


@pandas_udf(DoubleType())
def normal_quantile_udf(p: pd.Series) -> pd.Series:
    """Standard normal quantile of probabilities strictly between 0 and 1."""
    return pd.Series(K.norm_ppf(p.to_numpy(dtype=float)))


@pandas_udf(DoubleType())
def normal_logcdf_udf(z: pd.Series) -> pd.Series:
    """Logarithm of the standard normal distribution function; null for null."""
    return pd.Series(K.norm_logcdf(z.to_numpy(dtype=float)))


@pandas_udf(DoubleType())
def shapiro_p_udf(w: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of each (W, n); null for null."""
    return pd.Series([None if pd.isna(a) else K.shapiro_p(float(a), int(b)) for a, b in zip(w, n)], dtype="float64")


def _unpivot(df: DataFrame, cols, keys) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_s")).select(*keys, "_s.variable", "_s.value")


def _ranked(df: DataFrame, cols, keys) -> DataFrame:
    """keys, variable and the columns of ``ranked_values``."""
    series = [*keys, "variable"]
    return ranked_values(ordered_values(_unpivot(df, cols, keys), series, "value"), series)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(c)
    return out


def _shapiro_statistic() -> Column:
    """W from the sums of a series (n >= 3, not constant).

    The two outermost weights at either end have polynomials of their own,
    all others are expected normal order statistics over one divisor.
    """
    n, rsn = F.col("n"), 1.0 / F.sqrt("n")
    outer, inner = F.col("hi") - F.col("lo"), F.col("second_last") - F.col("second")
    m1, m2, length = F.col("top"), F.col("second_top"), F.sqrt("mm")
    a1 = _poly(K._C1, rsn) + m1 / length
    a2 = _poly(K._C2, rsn) + m2 / length
    left5 = F.col("mm") - 2 * m1 * m1
    fac5 = F.sqrt(left5 / (1 - 2 * a1 * a1))
    left = left5 - 2 * m2 * m2
    fac = F.sqrt(left / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    many = a1 * outer + a2 * inner + (F.col("mx") - m1 * outer - m2 * inner) / fac
    few = a1 * outer + (F.col("mx") - m1 * outer) / fac5
    # the weights' squares add up to one in each of the three forms
    weighted = F.when(n == 3, F.lit(0.5 ** 0.5) * outer).when(n <= 5, few).otherwise(many)
    return F.least(F.lit(1.0), weighted * weighted / F.col("m2"))


def check_normality(df: DataFrame, cols, keys=("project",), alpha: float = ALPHA,
                    critical_points=K.ANDERSON_NORMAL_POINTS,
                    significance_levels=K.ANDERSON_NORMAL_LEVELS) -> DataFrame:
    """Shapiro-Wilk and Anderson-Darling per key and variable; normal when Shapiro p > alpha.

    Null and NaN values are left out; a series without values has no row.
    Fewer than three values give null statistics and a null ``is_normal``; a
    constant series gives W = p = 1 and no A2.  No key may be called
    ``variable``, ``v``, ``at`` or like a column of ``ranked_values``.
    """
    keys = list(keys)
    series = [*keys, "variable"]
    n, i, v = F.col("n"), F.col("i"), F.col("v")
    z = F.try_divide(v - F.col("mean"), F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0))))
    rows = _ranked(df, cols, keys).where("n >= 1").withColumn("z", F.when(n > 1, z))
    rows = rows.select(*series, "v", "i", "n", "mean", "m2", normal_quantile_udf((i - 0.375) / (n + 0.25)).alias("m"),
                       normal_logcdf_udf("z").alias("below"), normal_logcdf_udf(-F.col("z")).alias("above"))
    sums = rows.groupBy(*series).agg(
        F.max("n").alias("n"), F.max("m2").alias("m2"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max(F.when(i == 2, v)).alias("second"), F.max(F.when(i == n - 1, v)).alias("second_last"),
        F.max("m").alias("top"), F.max(F.when(i == n - 1, F.col("m"))).alias("second_top"),
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * (v - F.col("mean"))).alias("mx"),
        F.sum((2 * i - 1) * F.col("below") + (2 * (n - i) + 1) * F.col("above")).alias("logs"))
    tested = n >= 3
    varied = tested & (F.col("hi") > F.col("lo"))
    w = F.when(varied, _shapiro_statistic()).when(tested, 1.0)
    sums = sums.withColumn("shapiro_statistic", w)
    sums = sums.withColumn("shapiro_p_value", F.when(varied, shapiro_p_udf("shapiro_statistic", "n")).when(tested, 1.0))
    points = F.array(*(F.rint(float(c) / (1 + 4.0 / n - 25.0 / n / n) * 1000) / 1000 for c in critical_points))
    return sums.select(
        *series, "n", "shapiro_statistic", "shapiro_p_value",
        F.when(varied, -n - F.col("logs") / n).alias("anderson_statistic"),
        F.when(varied, points).otherwise(F.array().cast("array<double>")).alias("anderson_critical_values"),
        F.array(*(F.lit(float(c)) for c in significance_levels)).alias("anderson_significance_levels"),
        F.when(tested, F.col("shapiro_p_value") > alpha).alias("is_normal"))


def qq_points(df: DataFrame, cols, keys=("project",)) -> DataFrame:
    """Ordered values against normal order-statistic medians, with the fitted line.

    Null and NaN values are left out.  A single value stands at 0 and has no
    line; a constant series has slope and r of 0.
    """
    keys = list(keys)
    series = [*keys, "variable"]
    n, i = F.col("n"), F.col("i")
    last = F.pow(F.lit(0.5), 1.0 / n)
    u = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    points = _ranked(df, cols, keys).select(*series, "i", "n", normal_quantile_udf(u).alias("theoretical"), F.col("v").alias("ordered"))
    points = written(points, "plot-points")  # the line and the points both read them
    x, y = "theoretical", "ordered"
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    constant = F.min(y) == F.max(y)
    line = points.where("n > 1").groupBy(*series).agg(
        F.when(constant, 0.0).otherwise(slope).alias("slope"), F.avg(x).alias("_x"), F.avg(y).alias("_y"),
        F.when(constant, 0.0).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("r"))
    line = line.select(*series, "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"), "r")
    joined = join_small(points, line, series, "left")
    return joined.select(*series, "i", "theoretical", "ordered", "slope", "intercept", "r")
