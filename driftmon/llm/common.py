"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import bisect
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmon.session import scratch_path

#: White space of the contracts, ``[\x20\x09-\x0D]``: fixed values.
WHITE = " \t\n\x0b\f\r"
#: A word of the contracts: a run of anything but that white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor only repeats work since this point.  The folder goes when the
    application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # zstd works on the heap; snappy keeps buffers outside it until a full collection
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``position`` (long, from 0) in the given total order.

    A range sort, then one offset per sorted partition: no task sees more than
    its own range.  Meant for narrow rows; the result is a written table.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    offsets, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets[r["_part"]] = total
        total += r["_n"]
    if not offsets:
        return at.withColumn("position", F.col("_at")).drop("_at")
    table = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("position", table[part] + within).drop("_at")


def as_struct(docs: DataFrame, **more: Column) -> tuple[DataFrame, str, dict[str, str]]:
    """Every row of ``docs`` as one struct column beside ``more``; all names are made up, so none can clash.

    Gives the frame, the struct's name and the names of ``more``; see :func:`from_struct`.
    """
    row, names = f"_{uuid.uuid4().hex}", {k: f"_{uuid.uuid4().hex}" for k in more}
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    return docs.select(whole, *(c.alias(names[k]) for k, c in more.items())), row, names


def from_struct(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(row).getField(c).alias(c) for c in columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``gone`` (one column of ids), with all their columns."""
    whole, row, names = as_struct(docs, id=F.col("doc_id").cast("long"))
    ids = gone.select(F.col(gone.columns[0]).alias("gone"))
    return from_struct(whole.join(ids, F.col(names["id"]) == F.col("gone"), "left_anti"), row, docs.columns)


def range_splits(df: DataFrame, key: str, rows_each: int, most: int = 16384) -> list:
    """Sorted, distinct key values that cut ``df`` into ranges of about ``rows_each`` rows.

    Actual keys, chosen by hash, so the cuts depend on the data alone, not on
    how it happens to be partitioned; at most ``most`` of them reach the driver.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    n = keys.count()
    k = min(most, n // max(1, rows_each))
    if not k:
        return []
    chosen = keys.orderBy(F.xxhash64(key), key).limit(k).collect()
    return sorted({r[0] for r in chosen})


def range_of(splits: list, key) -> int:
    """The range a key falls in; a split key is the first of its range."""
    return bisect.bisect_right(splits, key)


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def word_count(text: Column | str) -> Column:
    """Number of words (runs of non-white-space); null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
