"""Input views derived from the driver tables.

The reference has no sample data, so every query runs on views that Spark
derives from the given tables (their work grows with the tables):

* ``issues``      raw issue rows (documents x orders) for cleaning, labels, windows
* ``issue_documents`` the same rows nested like the reference's source documents
* ``predictions`` true / predicted classes per order, with drift over the years
* ``vectors``     embedding vectors with a project and a month window
* ``labelled_text`` documents x labels x orders, for fitting a classifier

Each view is defined twice: with the DataFrame API (what the queries run) and
as SQL text (what the DuckDB oracle runs).  Both must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmon.functions.dates import parsed_once
from driftmon.sources.tables import read_table


def _order_day(col: str = "o_orderdate"):
    return F.date_format(F.col(col).cast("date"), "yyyy-MM-dd")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw issues: nulls, unmapped labels, bad and pre-1900 dates, offsets, duplicates.

    Documents that also appear in ``labels`` are imported twice (new id,
    same fields), which gives the exact duplicates the cleaner removes.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    day = _order_day()
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Bug")
        .when(F.col("o_orderpriority") == "2-HIGH", "Bug Report")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "New Feature")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Support Request")
        .otherwise("Sub-task")
    )
    date = (
        F.when(F.col("doc_id") % 50 == 7, F.lit("0001-01-01T00:00:00.000+0000"))
        .when(F.col("doc_id") % 50 == 9, F.lit("not a date"))
        .when(F.col("doc_id") % 7 == 0, F.concat(day, F.lit("T23:30:00.000-0500")))
        .otherwise(F.concat(day, F.lit("T16:45:26.000+0000")))
    )
    relabelled = (read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"))
                  .distinct().withColumn("_again", F.lit(True)))
    joined = d.join(o, d.doc_id == o.o_orderkey).join(relabelled, "o_orderkey", "left")
    # one pass over the join: a relabelled document yields its row twice (new id, same fields)
    ids = F.when(F.col("_again"), F.array(F.col("doc_id"), F.col("doc_id") + 1000000)).otherwise(
        F.array(F.col("doc_id")))
    return joined.select(
        F.explode(ids).alias("issue_id"),
        F.concat(F.lit("P"), (F.col("doc_id") % 4).cast("string")).alias("project"),
        F.col("source").alias("title"),
        F.when(F.col("doc_id") % 25 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body"),
        label.alias("label"),
        date.alias("date"),
    )


ISSUES_SQL = """
WITH b AS (
  SELECT d.doc_id AS issue_id, concat('P', cast(d.doc_id % 4 AS varchar)) AS project,
         d.source AS title,
         CASE WHEN d.doc_id % 25 = 0 THEN NULL ELSE d.text END AS body,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Bug' WHEN '2-HIGH' THEN 'Bug Report'
              WHEN '3-MEDIUM' THEN 'New Feature' WHEN '4-NOT SPECIFIED' THEN 'Support Request'
              ELSE 'Sub-task' END AS label,
         CASE WHEN d.doc_id % 50 = 7 THEN '0001-01-01T00:00:00.000+0000'
              WHEN d.doc_id % 50 = 9 THEN 'not a date'
              WHEN d.doc_id % 7 = 0 THEN concat(strftime(cast(o.o_orderdate AS date), '%Y-%m-%d'), 'T23:30:00.000-0500')
              ELSE concat(strftime(cast(o.o_orderdate AS date), '%Y-%m-%d'), 'T16:45:26.000+0000') END AS date
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)
SELECT * FROM b
UNION ALL
SELECT issue_id + 1000000, project, title, body, label, date FROM b
WHERE issue_id IN (SELECT doc_id FROM labels)
"""


def issue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues nested like the source documents (``fields.issuetype.name`` ...)."""
    i = issues(spark, sf_dir)
    return i.select(
        "issue_id",
        "project",
        F.struct(
            F.col("title").alias("summary"),
            F.col("body").alias("description"),
            F.struct(F.col("label").alias("name")).alias("issuetype"),
            F.col("date").alias("created"),
        ).alias("fields"),
    )


def _joined_month_window():
    """The order's window behind a step that a filter on windows stays above: labels are parsed for joined rows only."""
    return parsed_once(_month_window(_order_day()))


def _month_window(day):
    month = F.substring(day, 1, 7)
    return F.concat(month, F.lit("_"), month)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier outcomes per order; errors grow with the year (visible drift).

    ``period`` is the month window label the window builder writes
    (``YYYY-MM_YYYY-MM``, range 1).
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    day = _order_day()
    year = F.substring(day, 1, 4).cast("int")
    truth = (
        F.when(F.col("o_orderstatus") == "F", "bug")
        .when(F.col("o_orderstatus") == "O", "feature")
        .otherwise("question")
    )
    wrong = (
        F.when(F.col("o_orderstatus") == "F", "feature")
        .when(F.col("o_orderstatus") == "O", "question")
        .otherwise("bug")
    )
    return o.select(
        F.col("o_orderkey").alias("issue_id"),
        F.concat(F.lit("P"), (F.col("o_orderkey") % 4).cast("string")).alias("project"),
        _month_window(day).alias("period"),
        truth.alias("y_true"),
        F.when((F.col("o_orderkey") * 31) % 17 >= year - 1994, truth).otherwise(wrong).alias("y_pred"),
    )


PREDICTIONS_SQL = """
SELECT o_orderkey AS issue_id, concat('P', cast(o_orderkey % 4 AS varchar)) AS project,
       concat(strftime(cast(o_orderdate AS date), '%Y-%m'), '_', strftime(cast(o_orderdate AS date), '%Y-%m')) AS period,
       CASE o_orderstatus WHEN 'F' THEN 'bug' WHEN 'O' THEN 'feature' ELSE 'question' END AS y_true,
       CASE WHEN (o_orderkey*31) % 17 >= year(o_orderdate) - 1994
            THEN CASE o_orderstatus WHEN 'F' THEN 'bug' WHEN 'O' THEN 'feature' ELSE 'question' END
            ELSE CASE o_orderstatus WHEN 'F' THEN 'feature' WHEN 'O' THEN 'question' ELSE 'bug' END END AS y_pred
FROM orders
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors placed in month windows (``YYYY-MM_YYYY-MM``)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return e.join(o, e.vec_id == o.o_orderkey).select(
        "vec_id",
        F.concat(F.lit("P"), (F.col("vec_id") % 2).cast("string")).alias("project"),
        _joined_month_window().alias("period"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


VECTORS_SQL = """
SELECT e.vec_id, concat('P', cast(e.vec_id % 2 AS varchar)) AS project,
       concat(strftime(cast(o.o_orderdate AS date), '%Y-%m'), '_', strftime(cast(o.o_orderdate AS date), '%Y-%m')) AS period,
       cast(e.embedding AS DOUBLE[]) AS embedding
FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id
"""


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality class and a month window, for fit / score."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        d.join(lab, "doc_id")
        .join(o, F.col("doc_id") == F.col("o_orderkey"))
        .select(
            "doc_id",
            F.concat(F.lit("P"), (F.col("doc_id") % 2).cast("string")).alias("project"),
            _joined_month_window().alias("period"),
            F.col("text"),
            F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"),
        )
    )


LABELLED_TEXT_SQL = """
SELECT d.doc_id, concat('P', cast(d.doc_id % 2 AS varchar)) AS project,
       concat(strftime(cast(o.o_orderdate AS date), '%Y-%m'), '_', strftime(cast(o.o_orderdate AS date), '%Y-%m')) AS period,
       d.text, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN orders o ON o.o_orderkey = d.doc_id
"""


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the fixture views it uses as CTEs."""
    texts = {
        "issues": ISSUES_SQL,
        "predictions": PREDICTIONS_SQL,
        "vectors": VECTORS_SQL,
        "labelled_text": LABELLED_TEXT_SQL,
    }
    body = sql.strip()
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({texts[v]})" for v in views)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
