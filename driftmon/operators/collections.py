"""Choosing projects ("collections"): requested names checked against the data."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def missing_names(spark: SparkSession, available: DataFrame, requested, project_col: str = "project") -> DataFrame:
    """Requested names absent from the data (``requested`` LEFT ANTI available)."""
    req = spark.createDataFrame([(r,) for r in requested], T.StructType([T.StructField(project_col, T.StringType())]))
    avail = available.select(project_col).distinct()
    return req.join(avail, project_col, "left_anti")


def select_collections(df: DataFrame, requested=None, on_missing: str = "raise",
                       project_col: str = "project"):
    """Keep the requested projects.  Returns ``(rows, missing_names)``.

    ``on_missing="raise"`` fails naming the absent projects (export);
    ``"warn"`` logs and skips them (clean / map).  No request = all projects.
    The request list comes from the caller, so the semi-join side is bounded.
    """
    if not requested:
        return df, []
    spark = df.sparkSession
    missing = [r[project_col] for r in missing_names(spark, df, requested, project_col).collect()]
    if missing:
        msg = f"collections not found: {', '.join(sorted(missing))}"
        if on_missing == "raise":
            raise ValueError(msg)
        log.warning(msg)
    req = F.broadcast(spark.createDataFrame([(r,) for r in requested], [project_col]))
    return df.join(req, project_col, "left_semi"), missing


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct windows, labels, years ..."""
    return df.select(*cols).distinct()
