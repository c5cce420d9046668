"""Queries: export, cleaning, labels, period keys, distribution tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmon.functions.text import NA_TOKENS, na_tokens_to_null
from driftmon.operators import cleaning, distribution, windows
from driftmon.operators.collections import select_collections
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import query
from driftmon.session import scratch_path
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views
from driftmon.sources.issues_io import read_issues_csv, write_issues_csv
from driftmon.sources.tables import read_table


def mapped_issues(spark, sf_dir):
    raw = fixtures.issues(spark, sf_dir)
    return cleaning.map_labels(cleaning.clean_issues(raw))


def windowed(spark, sf_dir, split_type, n):
    return windows.create_time_windows(mapped_issues(spark, sf_dir), split_type, n)


@query("flatten_fields", with_views(f"""
SELECT issue_id, project, {S.strip_unprintable("title")} AS title, {S.strip_unprintable("body")} AS body,
       {S.strip_unprintable("label")} AS label, {S.strip_unprintable("date")} AS date
FROM issues""", "issues"))
def q_flatten_fields(spark, sf_dir):
    docs = fixtures.issue_documents(spark, sf_dir)
    return cleaning.flatten_fields(docs, keys=("issue_id", "project"))


@query("clean_issues", with_views(S.CLEAN_ISSUES, "issues"))
def q_clean_issues(spark, sf_dir):
    return cleaning.clean_issues(fixtures.issues(spark, sf_dir))


@query("dedup_issues", with_views("""
SELECT project, count(*) AS n_rows, count(DISTINCT body) AS n_bodies
FROM (SELECT DISTINCT project, title, body, label, date FROM issues) d GROUP BY project""", "issues"))
def q_dedup_issues(spark, sf_dir):
    d = cleaning.dedup_issues(fixtures.issues(spark, sf_dir))
    return d.groupBy("project").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.countDistinct("body").alias("n_bodies"))


@query("filter_valid_dates", with_views(f"""
SELECT project, count(*) AS n_valid FROM issues WHERE {S.is_valid_date("date")} GROUP BY project""", "issues"))
def q_filter_valid_dates(spark, sf_dir):
    return (cleaning.filter_valid_dates(fixtures.issues(spark, sf_dir))
            .groupBy("project").agg(F.count(F.lit(1)).alias("n_valid")))


@query("map_labels", with_views(S.MAPPED_ISSUES, "issues"))
def q_map_labels(spark, sf_dir):
    return mapped_issues(spark, sf_dir)


@query("prepare_issues", with_views(f"""
WITH flat AS (
  SELECT project, {S.strip_unprintable("title")} AS title, {S.strip_unprintable("body")} AS body,
         {S.strip_unprintable("label")} AS label, {S.strip_unprintable("date")} AS date FROM issues),
clean AS (SELECT DISTINCT project, title, body, label, date FROM flat WHERE {S.is_valid_date("date")})
SELECT project, title, body, {S.map_label("label")} AS label, date FROM clean
WHERE {S.map_label("label")} IS NOT NULL""", "issues"))
def q_prepare_issues(spark, sf_dir):
    from driftmon.plans.jobs import prepare_issues

    return prepare_issues(fixtures.issue_documents(spark, sf_dir))


@query("select_collections", with_views("""
SELECT project, count(*) AS n FROM issues WHERE project IN ('P1', 'P3') GROUP BY project""", "issues"))
def q_select_collections(spark, sf_dir):
    chosen, _missing = select_collections(fixtures.issues(spark, sf_dir), ["P1", "P3", "P7"], on_missing="warn")
    return chosen.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


_NA_LIST = ", ".join(S.q(t) for t in NA_TOKENS)


@query("na_tokens_to_null", with_views(f"""
SELECT project,
  count(*) FILTER (WHERE title IS NULL OR title IN ({_NA_LIST})) AS null_titles,
  count(*) FILTER (WHERE body IS NULL OR body IN ({_NA_LIST})) AS null_bodies,
  count(*) FILTER (WHERE label IS NULL OR label IN ({_NA_LIST})) AS null_labels
FROM issues GROUP BY project""", "issues"))
def q_na_tokens_to_null(spark, sf_dir):
    i = fixtures.issues(spark, sf_dir)
    n = i.select("project", *[na_tokens_to_null(c).alias(c) for c in ("title", "body", "label")])
    return n.groupBy("project").agg(
        F.count_if(F.col("title").isNull()).alias("null_titles"),
        F.count_if(F.col("body").isNull()).alias("null_bodies"),
        F.count_if(F.col("label").isNull()).alias("null_labels"),
    )


def _period_counts_sql(split_type, n):
    return with_views(f"""
SELECT project, period, count(*) AS n FROM ({S.windowed_issues(split_type, n)}) w GROUP BY project, period""",
                      "issues")


def _period_counts(split_type, n):
    def run(spark, sf_dir):
        w = windowed(spark, sf_dir, split_type, n)
        return w.groupBy("project", "period").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, _s, _n in [("period_key_year", "year", 1), ("period_key_year_r5", "year", 5),
                      ("period_key_month_r3", "month", 3), ("period_key_month_r5", "month", 5),
                      ("period_key_day_r7", "day", 7), ("period_key_day", "day", 1)]:
    query(_name, _period_counts_sql(_s, _n))(_period_counts(_s, _n))


def _window_distribution_sql(split_type, n):
    return with_views(f"""
SELECT project, CASE WHEN grouping(period) = 1 THEN 'Total' ELSE period END AS period,
       CAST(count_if(lower(label) = 'bug') AS BIGINT) AS bug,
       CAST(count_if(lower(label) = 'feature') AS BIGINT) AS feature,
       CAST(count_if(lower(label) = 'question') AS BIGINT) AS question,
       grouping(period) = 1 AS is_total
FROM ({S.windowed_issues(split_type, n)}) w GROUP BY GROUPING SETS ((project, period), (project))""", "issues")


@query("window_distribution", _window_distribution_sql("year", 1))
def q_window_distribution(spark, sf_dir):
    return distribution.window_distribution(windowed(spark, sf_dir, "year", 1))


@query("window_distribution_month_r3", _window_distribution_sql("month", 3))
def q_window_distribution_m3(spark, sf_dir):
    return distribution.window_distribution(windowed(spark, sf_dir, "month", 3))


@query("overall_distribution", with_views(f"""
SELECT CASE WHEN grouping(project) = 1 THEN 'Total' ELSE project END AS project,
       CASE WHEN grouping(project) = 1 THEN NULL ELSE CAST(min({S.utc_year("date")}) AS INTEGER) END AS year_first_issue,
       CASE WHEN grouping(project) = 1 THEN NULL ELSE CAST(max({S.utc_year("date")}) AS INTEGER) END AS year_last_issue,
       CAST(count_if(lower(label) = 'bug') AS BIGINT) AS bug,
       CAST(count_if(lower(label) = 'feature') AS BIGINT) AS feature,
       CAST(count_if(lower(label) = 'question') AS BIGINT) AS question,
       grouping(project) = 1 AS is_total
FROM ({S.MAPPED_ISSUES}) m GROUP BY GROUPING SETS ((project), ())""", "issues"))
def q_overall_distribution(spark, sf_dir):
    return distribution.overall_distribution(mapped_issues(spark, sf_dir))


@query("class_counts", with_views(f"""
SELECT project, min(n) AS min_class_size, count(*) AS num_classes, CAST(sum(n) AS BIGINT) AS num_rows
FROM (SELECT project, label, count(*) AS n FROM ({S.MAPPED_ISSUES}) m GROUP BY project, label) c
GROUP BY project""", "issues"))
def q_class_counts(spark, sf_dir):
    return distribution.class_counts(mapped_issues(spark, sf_dir), keys=("project",))


@query("issues_csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS title, md5(replace(text, chr(0), '')) AS body_md5, length(replace(text, chr(0), '')) AS body_chars,
       source AS label, lang || '"' AS date FROM documents""")
def q_issues_csv_round_trip(spark, sf_dir):
    """Whole texts with their line breaks, commas and quotes written as CSV and read back by byte ranges."""
    docs = read_table(spark, sf_dir, "documents")
    issues = docs.select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body"), F.col("source").alias("label"),
                         F.concat("lang", F.lit('"')).alias("date"))
    path = scratch_path(spark, "issues-csv")
    write_issues_csv(issues, path)
    back = read_issues_csv(spark, path)
    return back.select("title", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"), "label", "date")
