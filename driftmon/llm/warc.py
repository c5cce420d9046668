"""WARC archives: writing pages, and reading them back by boundary-chain verification.

Reading cuts each archive at every place where a record could begin (the
version line).  Each candidate names its successor by its own header's length;
only what can be reached from the start of the file along these links is a
record, so a version line inside a payload is not.  Candidates whose links run
straight on are contracted into runs within the scan order, and pointer jumping
over the runs finds the reachable ones in a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmon.llm.common import materialise
from driftmon.session import scratch_path

#: Fixed values of the format.
VERSION = "WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GAP = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _GAP
_DATE = "2024-01-01T00:00:00Z"
#: Records of one archive file.
RECORDS_PER_FILE = 4096


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload)
    fives = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"),
    )
    digit = lambda v, k: F.substr(F.lit(BASE32), F.shiftright(v, k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda v: F.concat(*[digit(v, k) for k in (15, 10, 5, 0)])), "")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, last_id, revisit of each page.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest ``page_id`` is the response; rows that repeat that id are
    responses too.
    """
    some = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    some = some.withColumn("digest", F.unhex(F.sha1("payload")))
    last = some.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1")
    joined = some.join(materialise(last.drop("n"), "last-pages"), "digest", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(
        F.col("last_id"))
    return joined.withColumn("revisit", revisit).drop("digest")


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """One WARC record per page, in gzipped archives of at most ``per_file`` records under ``path``.

    Input: ``page_id, url, html``; other columns are ignored.  Null html is an
    empty payload, a null url an empty one; line breaks in a url are
    percent-encoded.  An empty table writes an archive without records.
    """
    rows = plan_records(pages, min_bytes)
    http = F.when(F.col("revisit"), F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1_base32(F.col("payload"))),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _id(F.col("last_id")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("http").cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(_GAP), F.col("http"), F.lit("\r\n"))  # the writer adds the last CRLF
    rows.withColumn("http", http).select(record.alias("value")).write.option("lineSep", "\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _header(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?im)^{name}: *([^\r\n]*)", 1)


def candidate_chain(spark: SparkSession, path: str) -> DataFrame:
    """Every place where a record could begin: file, off, seg_end, succ, value (what follows, up to the next place)."""
    cut = spark.read.option("lineSep", VERSION).text(path)
    cut = cut.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
    )
    head = F.substring_index("value", _GAP, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length: *(\d{1,15})", 1)
    total = F.when(
        (length != "") & F.contains(F.col("value"), F.lit(_GAP)),
        F.lit(len(VERSION) + 2 * len(_GAP)) + F.octet_length(head) + length.cast("long"),
    )
    cut = materialise(cut.withColumn("total", total).withColumn("bytes", F.octet_length("value").cast("long")), "segments")
    order = Window.partitionBy("file").orderBy("block", "nth")
    upto = F.sum(F.col("bytes") + len(VERSION)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keys = cut.select("file", "block", "nth", "total", "bytes", upto.alias("seg_end"))
    # what stands before the first version line of a file is no candidate
    off = F.col("seg_end") - F.col("bytes") - 2 * len(VERSION)
    keys = keys.select("file", "block", "nth", off.alias("off"), (F.col("seg_end") - len(VERSION)).alias("seg_end"),
                       (off + F.col("total")).alias("succ")).where("off >= 0")
    return cut, materialise(keys, "candidates")


def reachable(keys: DataFrame) -> DataFrame:
    """The candidates (file, off) that the links lead to from the start of each file."""
    order = Window.partitionBy("file").orderBy("off")
    keys = keys.withColumn("succ", F.when(F.col("succ") > F.col("off"), F.col("succ")))  # links only lead onward
    linked = keys.withColumn("before", F.lag("succ").over(order))
    odd = linked.where(~F.col("before").eqNullSafe(F.col("off")))
    targets = keys.where(~F.col("succ").eqNullSafe(F.col("seg_end"))).select("file", F.col("succ").alias("off")).where(
        "off is not null").distinct()
    heads = odd.select("file", "off").unionByName(targets.join(keys, ["file", "off"], "left_semi").select("file", "off"))
    heads = heads.distinct().withColumn("head", F.col("off"))
    runs = linked.join(heads, ["file", "off"], "left").withColumn("run", F.last("head", True).over(order))
    runs = materialise(runs.select("file", "off", "succ", "run"), "runs")
    jump = runs.groupBy("file", F.col("run").alias("at")).agg(F.max_by("succ", "off").alias("to"))
    ends = jump.join(jump.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi")  # leads to another run
    jump = materialise(ends.select("file", "at", "to"), "jumps")
    seen = runs.where("off = 0").select("file", F.col("off").alias("at"))
    step = 0
    while not jump.isEmpty():
        step += 1
        new = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        seen = materialise(seen.unionByName(new).distinct(), f"seen-{step}")
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = materialise(jump.join(onward, ["file", "to"]).select("file", "at", F.col("then").alias("to")), f"jump-{step}")
    return runs.join(seen.select("file", F.col("at").alias("run")), ["file", "run"], "left_semi").select("file", "off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: page_id, record_type, url, digest, refers_to, payload.

    ``payload`` is what the record itself holds, so empty for a revisit.
    Bytes that no chain from the file's start reaches are left out.
    """
    cut, keys = candidate_chain(spark, path)
    good = reachable(keys).withColumn("record", F.col("off"))
    order = Window.partitionBy("file").orderBy("off")
    owned = keys.join(good, ["file", "off"], "left").withColumn("record", F.last("record", True).over(order))
    owned = owned.where("record is not null")
    parts = Window.partitionBy("file", "record")
    owned = materialise(owned.withColumn("parts", F.count("*").over(parts)).select(
        "file", "block", "nth", "off", "record", "parts"), "owned")
    texts = cut.select("file", "block", "nth", "value").join(owned, ["file", "block", "nth"])
    one = texts.where("parts = 1").select("value")
    many = texts.where("parts > 1").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("p"))
    many = many.select(F.array_join(F.transform("p", lambda x: x["value"]), VERSION).alias("value"))
    whole = one.unionByName(many)
    head = F.substring_index("value", _GAP, 1)
    parsed = whole.select(head.alias("head"), F.length(head).alias("n"), "value")
    block = F.substr("value", F.col("n") + len(_GAP) + 1, F.length("value") - F.col("n") - 2 * len(_GAP))
    parsed = parsed.withColumn("block", block).withColumn("http", F.locate(_GAP, F.col("block")))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    as_long = lambda c: F.when(c != "", c.cast("long"))
    return parsed.select(
        as_long(number(_header(F.col("head"), "WARC-Record-ID"))).alias("page_id"),
        _header(F.col("head"), "WARC-Type").alias("record_type"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"),
        F.regexp_extract("head", r"(?im)^WARC-Payload-Digest: *sha1:([A-Z2-7]+)", 1).alias("digest"),
        as_long(number(_header(F.col("head"), "WARC-Refers-To"))).alias("refers_to"),
        F.substr("block", F.col("http") + len(_GAP), F.length("block")).alias("payload"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Pages written to archives and read back, one row per page.

    Columns: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``.  A response's size and digest are taken from the payload read;
    a revisit has those of the response it refers to.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes, per_file)
    records = read_archives(spark, path)
    records = materialise(records.select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"),
        F.when(F.col("record_type") == "response", sha1_base32(F.col("payload"))).alias("read_digest"),
    ), "records")
    full = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col(
        "digest")).agg(F.first("n").alias("full_n"), F.first("read_digest").alias("full_digest"))
    full = materialise(full, "full")
    joined = records.join(full, ["refers_to", "digest"], "left")
    return joined.select(
        "page_id",
        F.coalesce("full_n", "n").alias("payload_bytes"),
        F.coalesce("read_digest", "full_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT page_id, strlen(payload) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS last FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""
