"""Queries: tokens, embeddings, fitted classifier, evaluation, end-to-end jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftmon.operators import keyed_model as K
from driftmon.operators import model as M
from driftmon.operators import report as R
from driftmon.operators import windows as W
from driftmon.plans import jobs
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import query
from driftmon.plans.rounding import rounded
from driftmon.session import scratch_path
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views
from driftmon.sources.tables import read_table

TRAIN = W.target_window("year", 1995, 1996)


@query("tokenize_text", with_views("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: x <> '') AS tokens
           FROM documents)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct
FROM t"""))
def q_tokenize_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    t = M.tokenize_text(docs)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.size(F.array_distinct("tokens")).alias("n_distinct"))


def _split_text(spark, sf_dir):
    lt = fixtures.labelled_text(spark, sf_dir)
    return W.train_windows(lt, TRAIN), W.test_windows(lt, TRAIN, "month", rule="similarity")


@query("embed_text")
def q_embed_text(spark, sf_dir):
    train, test = _split_text(spark, sf_dir)
    e = M.embed_text(train, test, dim=256)
    return rounded(e.select("doc_id", "project", "period", F.size("embedding").alias("dim"),
                            F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))


@query("fit_and_score")
def q_fit_and_score(spark, sf_dir):
    train, test = _split_text(spark, sf_dir)
    model = M.fit_classifier(train)
    return M.score_classifier(model, test).select("doc_id", "project", "period", "y_true", "y_pred")


@query("evaluate_classifier")
def q_evaluate_classifier(spark, sf_dir):
    """Fit, save, load the saved model, score the test windows, report per window."""
    train, test = _split_text(spark, sf_dir)
    path = scratch_path(spark, "model")
    M.save_model(M.fit_classifier(train), path)
    scored = M.score_classifier(M.load_model(path), test)
    return rounded(R.report_by_window(scored))


# One range a project.
RANGES = [("P0", dt.date(1995, 1, 1), dt.date(1996, 12, 31)), ("P1", dt.date(1993, 6, 1), dt.date(1995, 3, 31))]


def _ranges(spark):
    return spark.createDataFrame(RANGES, "project string, train_start date, train_end date")


_RANGES_SQL = "(VALUES " + ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in RANGES) + ") r(project, first, last)"


@query("windows_by_project_range", with_views(f"""
SELECT project, period,
       CASE WHEN {S.period_start('period')} <= last AND {S.period_end('period')} >= first THEN 'train' ELSE 'test' END AS part,
       count(*) AS n
FROM labelled_text JOIN {_RANGES_SQL} USING (project)
WHERE {S.period_start('period')} > last OR ({S.period_start('period')} <= last AND {S.period_end('period')} >= first)
GROUP BY ALL""", "labelled_text"))
def q_windows_by_project_range(spark, sf_dir):
    """Train and test windows where every project has a range of its own."""
    texts, ranges = fixtures.labelled_text(spark, sf_dir), _ranges(spark)
    parts = {"train": W.train_windows_by_key(texts, ranges), "test": W.test_windows_by_key(texts, ranges, "month")}
    found = [p.groupBy("project", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k))
             for k, p in parts.items()]
    return found[0].unionByName(found[1])


@query("monitor_projects")
def q_monitor_projects(spark, sf_dir):
    """A range and a model per project, fitted together; one report per later window."""
    report, _, _, _ = jobs.monitor_projects(fixtures.labelled_text(spark, sf_dir), _ranges(spark), "month", rule="similarity")
    return rounded(report)


@query("validation_curve")
def q_validation_curve(spark, sf_dir):
    """Each project's regularisation chosen on its validation rows, all candidates fitted together."""
    _, curve = K.fit_validated(W.train_windows_by_key(fixtures.labelled_text(spark, sf_dir), _ranges(spark)), id_col="doc_id")
    return rounded(curve)


def _text_similarity(spark, sf_dir):
    return jobs.monitor_text_similarity(fixtures.labelled_text(spark, sf_dir), TRAIN, "month", id_col="doc_id", dim=256)


@query("text_similarity_by_period")
def q_text_similarity_by_period(spark, sf_dir):
    """The similarity job from text: split, sample, embed, and measure every later window."""
    return rounded(_text_similarity(spark, sf_dir))


@query("text_similarity_windows", with_views(f"""
SELECT project, period, count(*) AS num_samples FROM labelled_text
WHERE {S.period_start('period')} > DATE '{TRAIN[1]}' GROUP BY project, period""", "labelled_text"))
def q_text_similarity_windows(spark, sf_dir):
    """Windows and rows of the similarity job."""
    return _text_similarity(spark, sf_dir).select("project", "period", "num_samples")
