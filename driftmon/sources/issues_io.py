"""Sources and sinks: issue documents, issue CSV, partitioned windows, results.

Every reader takes an explicit schema (no inference pass over the data, and
partition values such as ``1999_1999`` stay strings).
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmon.sources.csv_ranges import read_csv_ranges

ISSUE_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("fields", T.StructType([
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("issuetype", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("created", T.StringType()),
    ])),
])

ISSUE_CSV_SCHEMA = T.StructType([
    T.StructField(c, T.StringType()) for c in ("title", "body", "label", "date")
])

WINDOW_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("split_type", T.StringType()),
    T.StructField("range", T.IntegerType()),
    T.StructField("project", T.StringType()),
    T.StructField("period", T.StringType()),
])

WINDOW_PARTITIONS = ["split_type", "range", "project", "period"]


def read_issue_documents(spark: SparkSession, path: str, schema: T.StructType = ISSUE_DOCUMENT_SCHEMA,
                         fmt: str = "json") -> DataFrame:
    """Nested issue documents (JSON Lines dump by default), only the four fields used.

    Any DataFrame source with the same nested shape works (``fmt`` is passed
    to ``spark.read.format``), e.g. a document-database connector if installed.
    """
    return spark.read.format(fmt).schema(schema).load(path)


def read_issues_csv(spark: SparkSession, path: str, schema: T.StructType = ISSUE_CSV_SCHEMA) -> DataFrame:
    """Issue CSV: header, quoted multi-line fields of any length, NUL bytes removed.

    One large file is read by many tasks (:mod:`driftmon.sources.csv_ranges`).
    """
    df = read_csv_ranges(spark, path, schema)
    return df.select(*[F.replace(F.col(c), F.lit("\u0000"), F.lit("")).alias(c) for c in df.columns])


def write_issues_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """CSV with header, quotes doubled (not backslash-escaped), spaces kept."""
    w = (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """One folder per (split, range, project, period); rewriting a window replaces only it.

    Rows are clustered by the partition columns first so each task writes few
    files (no small-file explosion at scale); the ``rebalance`` hint lets AQE
    split a hot (project, window) over several writers instead of one task.
    """
    cols = [f.name for f in WINDOW_SCHEMA.fields]
    (
        windows.select(*cols)
        .hint("rebalance", *WINDOW_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*WINDOW_PARTITIONS)
        .parquet(path)
    )


def read_windows(spark: SparkSession, path: str, split_type: str | None = None, range_size: int | None = None,
                 projects=None) -> DataFrame:
    """Windows back with the declared schema; the filters prune folders, not rows."""
    df = spark.read.schema(WINDOW_SCHEMA).parquet(path)
    if split_type:
        df = df.where(F.col("split_type") == split_type)
    if range_size:
        df = df.where(F.col("range") == int(range_size))
    if projects:
        df = df.where(F.col("project").isin(list(projects)))
    return df


def discover_projects(windows: DataFrame) -> DataFrame:
    """Projects and windows present (answered from partition values)."""
    return windows.select("split_type", "range", "project", "period").distinct()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Results (reports, similarity, test results) as a table keyed by its columns."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table_at(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a result table; a missing path is an error naming it."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    try:
        return r.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no results at {path}") from e


#: What names a run of a classifier or a similarity job; result tables are foldered by it.
RUN_COLUMNS = ("model_type", "split_type", "range", "train_start", "train_end")
_RUN_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _run_values(run: dict) -> dict[str, str]:
    unknown = set(run) - set(RUN_COLUMNS)
    if unknown:
        raise ValueError(f"not part of a run's name: {sorted(unknown)}; known: {', '.join(RUN_COLUMNS)}")
    values = {c: str(run[c]) for c in RUN_COLUMNS if c in run}
    for c, v in values.items():
        if not _RUN_VALUE.fullmatch(v):
            raise ValueError(f"{c} {v!r} cannot name a folder")
    return values


def write_run(df: DataFrame, path: str, run: dict) -> None:
    """The results of one run: replaces exactly that run's rows, so a rerun changes nothing else.

    ``run`` gives every one of ``RUN_COLUMNS``; they become folders below
    ``path``.  A run with no rows is kept as an empty one.
    """
    values = _run_values(run)
    missing = [c for c in RUN_COLUMNS if c not in values]
    if missing:
        raise ValueError(f"a run needs {', '.join(missing)}")
    clash = sorted(set(df.columns) & set(RUN_COLUMNS))
    if clash:
        raise ValueError(f"columns named like parts of a run: {', '.join(clash)}")
    df.write.mode("overwrite").parquet("/".join([path.rstrip("/"), *(f"{c}={v}" for c, v in values.items())]))


def read_runs(spark: SparkSession, path: str, **run) -> DataFrame:
    """Results of the runs that match ``run`` (all without arguments), run columns as strings.

    The choice prunes folders.  No matching run gives no rows; a missing table
    is an error naming it.
    """
    found = read_table_at(spark, path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in RUN_COLUMNS else f for f in found])
    df = read_table_at(spark, path, schema=schema)
    for c, v in _run_values(run).items():
        df = df.where(F.col(c) == v)
    return df
