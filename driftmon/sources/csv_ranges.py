"""CSV files read in parallel, also when quoted fields hold line breaks.

A file with line breaks inside quotes cannot be cut at any line.  Here Spark's
text source cuts it into byte ranges at lines; a first pass counts the quotes
of each range, a running sum over a file's ranges tells whether a range starts
inside quotes, and a second pass cuts every range into records on its own.
Only records that cross a border are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmon.sources.scratch import written

#: What the parser puts in place of an empty field; no text holds it.
_NO_VALUE = "\0\0none\0\0"
_PIECE = "file string, start long, part string, text string"


def _lines(spark: SparkSession, path) -> DataFrame:
    df = spark.read.option("lineSep", "\n").text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def range_states(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether a byte range of ``lines (file, start, line)`` starts inside quotes.

    The running sum is over one narrow row for each range of a file.
    """
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "start").agg(F.sum(quotes % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def record_pieces(lines: DataFrame, states) -> DataFrame:
    """file, start, part, text: the records of each range; ``part`` tells which are whole.

    ``whole``: a record of its own.  ``tail``: a record that goes on in the next
    range.  ``head``: the end of one that began before.  ``through``: a whole
    range inside one record.  ``states`` is a broadcast of {file: (starts, inside)}.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, part, held = None, False, "whole", []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            # what is left of a range goes on in the next one
            if key is not None and held:
                out.append((*key, "through" if part == "head" else "tail", "\n".join(held)))

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != key:
                    close()
                    key, held = (file, start), []
                    starts, inside = states.value[file]
                    at = int(np.searchsorted(starts, start))
                    if at == len(starts) or starts[at] != start:
                        raise ValueError(f"the byte ranges of {file} changed while it was read; read it again")
                    open_ = bool(inside[at])
                    part = "head" if open_ else "whole"
                held.append(line)
                open_ ^= line.count('"') % 2 == 1
                if not open_:
                    text = "\n".join(held)
                    out.append((*key, part, text[:-1] if text.endswith("\r") else text))
                    size += len(text)
                    part, held = "whole", []
                if size > 4_000_000 or len(out) > 20_000:
                    yield _pieces(out)
                    out, size = [], 0
        close()
        if out:
            yield _pieces(out)

    return lines.mapInArrow(run, _PIECE)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "start", "part", "text"])


def _stitched(pieces: DataFrame) -> DataFrame:
    """text of the records that cross borders: a tail, the ranges that are inside it, and a head."""
    crossing = pieces.where("part <> 'whole'")
    # within a range the head comes before the tail
    order = F.when(F.col("part") == "head", 0).otherwise(1)
    so_far = Window.partitionBy("file").orderBy("start", order)
    narrow = crossing.select("file", "start", "part").withColumn("record", F.sum((F.col("part") == "tail").cast("long")).over(so_far))
    # record 0 is the rest of a header that crosses a border
    placed = crossing.join(narrow.where("record > 0"), ["file", "start", "part"])
    together = placed.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return together.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def csv_records(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """text of every record of the CSV files at ``path``, in many tasks however large a file is.

    Quotes are doubled inside quoted fields (RFC 4180) and do not stand in
    unquoted ones; lines end in LF or CRLF.  With ``header`` each file's first
    record is left out.  Empty lines between records are no records; a quote
    that never closes makes the rest of its file one record.  The driver holds
    one number for each byte range (128 MB each by default).
    """
    lines = _lines(spark, path)
    found = range_states(lines).collect()
    by_file: dict[str, list] = {}
    for r in found:
        by_file.setdefault(r["file"], []).append((r["start"], r["inside"]))
    states = {f: tuple(np.array(x) for x in zip(*sorted(v), strict=True)) for f, v in by_file.items()}
    pieces = record_pieces(lines, spark.sparkContext.broadcast(states))
    if header:
        # a file's first record is the first row of its range 0
        pieces = pieces.withColumn("at", F.monotonically_increasing_id())
    pieces = written(pieces, "csv-pieces")
    if header:
        first = pieces.where("start = 0").groupBy("file").agg(F.min("at").alias("at"))
        pieces = pieces.join(first, ["file", "at"], "left_anti").drop("at")
    records = pieces.where("part = 'whole'").select("text").unionByName(_stitched(pieces))
    return records.where("text <> ''")


def read_csv_ranges(spark: SparkSession, path, schema: T.StructType, header: bool = True) -> DataFrame:
    """The CSV files at ``path`` as columns of ``schema``; see :func:`csv_records`.

    An empty field is null, a quoted empty field an empty string.
    """
    options = {"escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE", "nullValue": _NO_VALUE}
    row = F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("row")
    return csv_records(spark, path, header).select(row).select("row.*")
