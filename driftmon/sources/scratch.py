"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftmon.session import scratch_path


def written(df: DataFrame, name: str, schema=None) -> DataFrame:
    """``df`` written once as Parquet and read back: later plans scan files that every executor can reach.

    The folder goes when the application ends.  ``schema`` names the types to
    read back where they differ (a vector type over its plain fields).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(schema or df.schema).parquet(path)
