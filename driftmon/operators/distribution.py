"""Label-distribution tables with a total row (one aggregation, grouping sets).

Counts are partial aggregates (map-side combine), so the shuffle carries one
row per (task, key) however the rows are spread over projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.functions.dates import parse_utc

# The classes counted, in table order.
CLASSES = ("bug", "feature", "question")


def _class_counts(label_col: str):
    low = F.lower(F.col(label_col))
    return [F.count_if(low == c).cast("bigint").alias(c) for c in CLASSES]


def overall_distribution(df: DataFrame, project_col: str = "project", label_col: str = "label",
                         date_col: str = "date") -> DataFrame:
    """Per project: first and last year (UTC) and the class counts, plus a ``Total`` row.

    The total row comes first (``is_total``) and has no years.
    """
    year = F.year(parse_utc(date_col))
    agg = df.groupingSets([[project_col], []], project_col).agg(
        F.min(year).cast("int").alias("year_first_issue"),
        F.max(year).cast("int").alias("year_last_issue"),
        *_class_counts(label_col),
        F.grouping(project_col).alias("_g"),
    )
    total = F.col("_g") == 1
    return agg.select(
        F.when(total, F.lit("Total")).otherwise(F.col(project_col)).alias(project_col),
        F.when(total, F.lit(None).cast("int")).otherwise(F.col("year_first_issue")).alias("year_first_issue"),
        F.when(total, F.lit(None).cast("int")).otherwise(F.col("year_last_issue")).alias("year_last_issue"),
        *CLASSES,
        total.alias("is_total"),
    )


def window_distribution(df: DataFrame, keys=("project",), period_col: str = "period",
                        label_col: str = "label") -> DataFrame:
    """Per key and window: class counts; plus one ``Total`` row per key."""
    keys = list(keys)
    agg = df.groupingSets([[*keys, period_col], keys], *keys, period_col).agg(
        *_class_counts(label_col), F.grouping(period_col).alias("_g")
    )
    total = F.col("_g") == 1
    return agg.select(
        *keys,
        F.when(total, F.lit("Total")).otherwise(F.col(period_col)).alias(period_col),
        *CLASSES,
        total.alias("is_total"),
    )


def ordered_table(dist: DataFrame, keys=("project",), period_col: str = "period") -> DataFrame:
    """Display order: per key the total row first, then windows by label."""
    return dist.orderBy(*keys, F.col("is_total").desc(), period_col)


def class_counts(df: DataFrame, keys=(), label_col: str = "label") -> DataFrame:
    """Rows per class, the smallest class size and the number of classes per key."""
    keys = list(keys)
    per_class = df.groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("n"))
    return per_class.groupBy(*keys).agg(
        F.min("n").alias("min_class_size"),
        F.count(F.lit(1)).alias("num_classes"),
        F.sum("n").alias("num_rows"),
    )
