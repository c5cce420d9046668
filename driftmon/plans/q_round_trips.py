"""Queries: sources, renamed columns, label names, coerced dates, stacked and sorted windows, saved models."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmon.functions.dates import coerce_date
from driftmon.functions.labels_index import index_labels, label_dictionary, unindex_labels
from driftmon.operators import cleaning, series
from driftmon.operators import model as M
from driftmon.operators import windows as W
from driftmon.operators.collections import distinct_values, select_collections
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import query
from driftmon.plans.q_models import TRAIN, _split_text
from driftmon.plans.q_prepare import mapped_issues, windowed
from driftmon.session import scratch_path
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views
from driftmon.sources.issues_io import read_issue_documents


def _cells(df):
    return df.select("project", "title", F.md5("body").alias("body_md5"), "label", "date")


@query("issue_documents_round_trip", with_views("""
SELECT project, coalesce(title, '') AS title, md5(coalesce(body, '')) AS body_md5, coalesce(label, '') AS label,
       coalesce(date, '') AS date FROM issues""", "issues"))
def q_issue_documents_round_trip(spark, sf_dir):
    """Nested issue documents written as JSON lines, read with the explicit schema and flattened, texts untouched."""
    path = scratch_path(spark, "issue-documents")
    fixtures.issue_documents(spark, sf_dir).write.json(path)
    return _cells(cleaning.flatten_fields(read_issue_documents(spark, path), printable_only=False))


@query("rename_issue_columns", with_views("""
SELECT project, title, md5(body) AS body_md5, label, date FROM issues""", "issues"))
def q_rename_issue_columns(spark, sf_dir):
    """Columns under the dotted names of the export get their short names."""
    exported = fixtures.issues(spark, sf_dir).select("project", *(F.col(c).alias(dotted) for c, dotted in cleaning.INPUT_FIELDS.items()))
    return _cells(cleaning.rename_issue_columns(exported))


@query("select_collections_strict", with_views("""
SELECT project, count(*) AS n FROM issues WHERE project IN ('P0', 'P2') GROUP BY project""", "issues"))
def q_select_collections_strict(spark, sf_dir):
    chosen, _ = select_collections(fixtures.issues(spark, sf_dir), ["P0", "P2"], on_missing="raise")
    return chosen.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("unindex_labels", with_views(f"""
SELECT project, label, count(*) AS n FROM ({S.MAPPED_ISSUES}) m GROUP BY project, label""", "issues"))
def q_unindex_labels(spark, sf_dir):
    """Labels to ids and back."""
    m = mapped_issues(spark, sf_dir)
    names = label_dictionary(m)
    ids = index_labels(m, names).select("project", "label_id")
    return unindex_labels(ids, names).groupBy("project", "label").agg(F.count(F.lit(1)).alias("n"))


@query("coerce_date", with_views("""
SELECT issue_id, CAST(epoch(try_strptime(date, '%Y-%m-%dT%H:%M:%S.%g%z')) AS BIGINT) AS at FROM issues""", "issues"))
def q_coerce_date(spark, sf_dir):
    """Raw issue dates as instants; what is no date becomes null."""
    return fixtures.issues(spark, sf_dir).select("issue_id", F.unix_seconds(coerce_date("date")).alias("at"))


@query("distinct_values", with_views(f"""
SELECT DISTINCT project, label FROM ({S.MAPPED_ISSUES}) m""", "issues"))
def q_distinct_values(spark, sf_dir):
    return distinct_values(mapped_issues(spark, sf_dir), "project", "label")


@query("stack_windows", with_views(f"""
SELECT split_type, period, count(*) AS n FROM (
  SELECT 'year' AS split_type, period FROM ({S.windowed_issues("year", 1)}) y
  UNION ALL SELECT 'month', period FROM ({S.windowed_issues("month", 3)}) m
  UNION ALL SELECT 'day', period FROM ({S.windowed_issues("day", 7)}) d) w GROUP BY split_type, period""", "issues"))
def q_stack_windows(spark, sf_dir):
    """Windows of three sizes in one frame; the day windows come without some columns."""
    frames = [windowed(spark, sf_dir, s, n) for s, n in (("year", 1), ("month", 3), ("day", 7))]
    stacked = series.stack_windows([*frames[:2], frames[2].drop("title", "body")])
    return stacked.groupBy("split_type", "period").agg(F.count(F.lit(1)).alias("n"))


@query("earliest_windows", with_views(f"""
SELECT period, count(*) AS n FROM ({S.windowed_issues("month", 3)}) w GROUP BY period
ORDER BY {S.period_start("period")} LIMIT 10""", "issues"))
def q_earliest_windows(spark, sf_dir):
    """Report of the ten earliest windows and their sizes."""
    sizes = windowed(spark, sf_dir, "month", 3).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return W.sort_periods(sizes).limit(10)


@query("saved_model_scores", with_views(f"""
SELECT project, period, y_true, count(*) AS n, count(*) AS n_same
FROM (SELECT project, period, label AS y_true FROM labelled_text WHERE {S.period_start("period")} > DATE '{TRAIN[1]}') t
GROUP BY project, period, y_true""", "labelled_text"))
def q_saved_model_scores(spark, sf_dir):
    """A fitted classifier and its saved copy score the same rows; ``n_same`` counts equal classes."""
    train, test = _split_text(spark, sf_dir)
    path = scratch_path(spark, "model")
    model = M.fit_classifier(train)
    M.save_model(model, path)
    own = M.score_classifier(model, test).select("doc_id", "project", "period", "y_true", "y_pred")
    back = M.score_classifier(M.load_model(path), test).select("doc_id", F.col("y_pred").alias("again"))
    return own.join(back, "doc_id").groupBy("project", "period", "y_true").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred") == F.col("again")).alias("n_same"))
