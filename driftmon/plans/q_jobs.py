"""Queries: end-to-end jobs and the streaming form of the distribution table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from driftmon.operators import windows as W
from driftmon.operators.sampling import sample_training_data
from driftmon.plans import jobs
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import ORACLES, query
from driftmon.plans.q_prepare import mapped_issues, windowed
from driftmon.plans.q_series import AUTO_TEST_SQL
from driftmon.plans.q_similarity import split_vectors
from driftmon.plans.rounding import r, rounded
from driftmon.session import scratch_path
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views
from driftmon.streaming.distribution_stream import (
    read_issue_stream, start_distribution_query, window_distribution_stream)

TRAIN = W.target_window("year", 1995, 1996)


@query("distribution_tables_overall", ORACLES["overall_distribution"])
def q_distribution_tables(spark, sf_dir):
    """The job's whole table, totals included."""
    return jobs.distribution_tables(mapped_issues(spark, sf_dir), "overall")


@query("distribution_tables_windows", ORACLES["window_distribution_month_r3"])
def q_distribution_tables_windows(spark, sf_dir):
    return jobs.distribution_tables(mapped_issues(spark, sf_dir), "windows", "month", 3)


@query("build_windows_job", with_views(f"""
SELECT project, period, count(*) AS n FROM ({S.windowed_issues("month", 1)}) w GROUP BY ALL""", "issues"))
def q_build_windows(spark, sf_dir):
    path = scratch_path(spark, "windows")
    jobs.build_windows(mapped_issues(spark, sf_dir), "month", 1, path)
    from driftmon.sources.issues_io import read_windows

    return read_windows(spark, path, "month", 1).groupBy("project", "period").agg(F.count(F.lit(1)).alias("n"))


@query("monitor_classifier")
def q_monitor_classifier(spark, sf_dir):
    """Train on 1995-1996 issue windows, score the later windows, one report per window."""
    w = windowed(spark, sf_dir, "year", 1)
    report, _, _ = jobs.monitor_classifier(w, TRAIN, "year", labels=["bug", "feature", "question"])
    return rounded(report)


def _few_shot(spark, sf_dir):
    w = windowed(spark, sf_dir, "year", 1)
    train = W.load_model_frame(w, TRAIN, "year", labels=["bug", "feature", "question"])
    return sample_training_data(train, "balanced", label_col="label", id_col=None, n=20, keys=["project"])


@query("few_shot_training_rows", with_views(f"""
WITH c AS (SELECT project, label, count(*) AS n FROM ({S.windowed_issues("year", 1)}) w
           WHERE {S.period_start('period')} <= DATE '{TRAIN[1]}' AND {S.period_end('period')} >= DATE '{TRAIN[0]}'
             AND label IN ('bug', 'feature', 'question') GROUP BY project, label)
SELECT project, label, least(min(n) OVER (PARTITION BY project), 20) AS n FROM c""", "issues"))
def q_few_shot_training_rows(spark, sf_dir):
    """Balanced training rows of cleaned issues, which carry no id."""
    return _few_shot(spark, sf_dir).groupBy("project", "label").agg(F.count(F.lit(1)).alias("n"))


@query("monitor_classifier_few_shot")
def q_monitor_classifier_few_shot(spark, sf_dir):
    """The classifier job on 20 rows a class and project, one report per later window."""
    report, _, _ = jobs.monitor_classifier(windowed(spark, sf_dir, "year", 1), TRAIN, "year", sampling="balanced",
                                           samples_per_class=20, labels=["bug", "feature", "question"])
    return rounded(report)


@query("write_read_runs", with_views(f"""
WITH c AS (SELECT project, period, count(*) AS support FROM predictions GROUP BY project, period),
p AS (SELECT project, period, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions GROUP BY project, period)
SELECT 'logistic' AS model_type, '1995-01-01' AS train_start, project, period, {r("accuracy")} AS f1_score, support
FROM c JOIN p USING (project, period) WHERE project = 'P1'
UNION ALL SELECT 'naive_bayes', '1995-01-01', project, period, {r("accuracy")}, support FROM c JOIN p USING (project, period)""",
                                    "predictions"))
def q_write_read_runs(spark, sf_dir):
    """Two runs' reports written, one written again with fewer projects, both read back."""
    from driftmon.operators import report as R
    from driftmon.sources.issues_io import read_runs, write_run

    path = scratch_path(spark, "runs")
    report = R.report_by_window(fixtures.predictions(spark, sf_dir)).where("class = 'accuracy' AND scope = 'window'")
    run = {"split_type": "month", "range": 1, "train_start": TRAIN[0], "train_end": TRAIN[1]}
    write_run(report, path, {"model_type": "logistic", **run})
    write_run(report, path, {"model_type": "naive_bayes", **run})
    write_run(report.where("project = 'P1'"), path, {"model_type": "logistic", **run})
    both = read_runs(spark, path, train_end=TRAIN[1])
    return rounded(both.select("model_type", "train_start", "project", "period", "f1_score", "support"))


@query("relate_similarity_to_quality", AUTO_TEST_SQL)
def q_relate(spark, sf_dir):
    test, train = split_vectors(spark, sf_dir)
    sim = jobs.monitor_similarity(train, test, "mean", include_distribution=False)
    from driftmon.operators import report as R

    rep = R.report_by_window(fixtures.predictions(spark, sf_dir))
    out = jobs.relate_similarity_to_quality(sim, rep)
    return rounded(out["correlation"])


@query("performance_timeline_job", ORACLES["performance_timeline"])
def q_timeline_job(spark, sf_dir):
    from driftmon.operators import report as R

    return rounded(jobs.performance_timeline(R.report_by_window(fixtures.predictions(spark, sf_dir))))


@query("window_distribution_stream", with_views(f"""
WITH v AS (SELECT project, title, body, {S.map_label("label")} AS label, date FROM issues
           WHERE {S.is_valid_date("date")}),
k AS (SELECT project, label, {S.period_key(S.wall_clock("date"), "year", 1)} AS period FROM v
      WHERE label IS NOT NULL AND {S.wall_clock("date")} IS NOT NULL)
SELECT project, period, CAST(count_if(label = 'bug') AS BIGINT) AS bug,
       CAST(count_if(label = 'feature') AS BIGINT) AS feature,
       CAST(count_if(label = 'question') AS BIGINT) AS question
FROM k GROUP BY project, period""", "issues"))
def q_window_distribution_stream(spark, sf_dir):
    """Issues land as JSON files; a stream keeps the per-window counts up to date."""
    src = scratch_path(spark, "issue-stream")
    raw = fixtures.issues(spark, sf_dir).select("project", "title", "body", "label", "date")
    raw.write.mode("overwrite").json(os.path.join(src, "batch-0"))
    stream = read_issue_stream(spark, os.path.join(src, "batch-*"), max_files=4)
    name = "dist_" + os.path.basename(src).replace("-", "_")
    q = start_distribution_query(window_distribution_stream(stream), scratch_path(spark, "stream-ckpt"),
                                 query_name=name, trigger_once=True)
    q.awaitTermination()
    latest = spark.table(name)
    return latest.groupBy("project", "period").agg(*[F.max(c).alias(c) for c in ("bug", "feature", "question")])
