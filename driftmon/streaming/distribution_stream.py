"""Incremental label-distribution tables with Structured Streaming.

The batch jobs rebuild the distribution tables from all issues.  When new
issue files keep arriving (a daily export), the same column functions run
on a file stream: clean -> map labels -> window key -> per-(project, window)
class counts kept in the streaming state and emitted in ``update`` mode.

Calendar windows here are label buckets, not event-time windows, so no
watermark is needed for correctness; state grows with the number of
(project, window) pairs, which is small.  De-duplication across batches uses
``dropDuplicatesWithinWatermark`` on the content columns when a watermark
column is given, bounding that state too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmon.functions.dates import is_valid_date, parse_wall_clock
from driftmon.functions.labels import map_label
from driftmon.functions.periods import period_key
from driftmon.functions.text import strip_nul
from driftmon.operators.distribution import CLASSES
from driftmon.sources.issues_io import ISSUE_CSV_SCHEMA

STREAM_SCHEMA = T.StructType([T.StructField("project", T.StringType()), *ISSUE_CSV_SCHEMA.fields])


def read_issue_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """New issue files in ``path`` as a stream (explicit schema, bounded batch size)."""
    return (spark.readStream.format(fmt).schema(STREAM_SCHEMA)
            .option("maxFilesPerTrigger", max_files).load(path))


def window_distribution_stream(stream: DataFrame, split_type: str = "year", range_size: int = 1,
                               watermark: str | None = None, delay: str = "30 days") -> DataFrame:
    """Running class counts per (project, window) of a stream of raw issue rows.

    With ``watermark`` repeated rows are dropped within ``delay`` of each
    other; an issue whose date is older than the latest one seen by more than
    ``delay`` comes too late and is not counted.  Without it every row counts
    and repeated rows are kept.
    """
    rows = stream.select("project", *[strip_nul(c).alias(c) for c in ("title", "body", "label", "date")])
    rows = rows.where(is_valid_date("date"))
    if watermark:
        rows = (rows.withColumn("_event", parse_wall_clock("date")).withWatermark("_event", delay)
                .dropDuplicatesWithinWatermark(["project", "title", "body", "label", "date"]))
    rows = rows.withColumn("label", map_label("label")).where(F.col("label").isNotNull())
    ts = parse_wall_clock("date")
    keyed = rows.where(ts.isNotNull()).withColumn("period", period_key(ts, split_type, range_size))
    low = F.lower(F.col("label"))
    return keyed.groupBy("project", "period").agg(*[F.count_if(low == c).alias(c) for c in CLASSES])


def start_distribution_query(counts: DataFrame, checkpoint: str, sink_path: str | None = None,
                             query_name: str = "window_distribution", trigger_once: bool = False):
    """Run the stream; results go to memory (tests) or to a sink written per batch."""
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).queryName(query_name)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink_path:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)
        return w.foreachBatch(write).start()
    return w.format("memory").start()
