"""Queries: confusion counts, classification reports, macro-F1 series, timeline."""

from __future__ import annotations

from driftmon.functions import periods as P
from driftmon.operators import report as R
from driftmon.plans.catalog import query
from driftmon.plans.q_windows import _info_sql
from driftmon.plans.rounding import r, rounded
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views

REPORT_SQL = f"""
WITH conf AS (SELECT project, period, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL),
s AS (SELECT project, period, y_true AS class, n AS support, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp,
             0 AS predicted FROM conf
      UNION ALL SELECT project, period, y_pred, 0, 0, n FROM conf),
g AS (SELECT project, CASE WHEN grouping(period) = 1 THEN 'overall' ELSE 'window' END AS scope,
             period, class, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(support) AS DOUBLE) AS support,
             CAST(sum(predicted) AS DOUBLE) AS predicted
      FROM s GROUP BY GROUPING SETS ((project, period, class), (project, class))),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
             CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM g),
t AS (SELECT project, scope, period, avg(precision) AS m_p, avg(recall) AS m_r, avg(f1) AS m_f,
             sum(precision * support) / sum(support) AS w_p, sum(recall * support) / sum(support) AS w_r,
             sum(f1 * support) / sum(support) AS w_f, sum(tp) / sum(support) AS acc, sum(support) AS support
      FROM m GROUP BY project, scope, period),
report AS (
  SELECT project, scope, period, class, precision, recall, f1 AS f1_score, CAST(support AS BIGINT) AS support FROM m
  UNION ALL SELECT project, scope, period, 'macro avg', m_p, m_r, m_f, CAST(support AS BIGINT) FROM t
  UNION ALL SELECT project, scope, period, 'weighted avg', w_p, w_r, w_f, CAST(support AS BIGINT) FROM t
  UNION ALL SELECT project, scope, period, 'accuracy', NULL, NULL, acc, CAST(support AS BIGINT) FROM t)
"""


def _report(spark, sf_dir):
    return R.report_by_window(fixtures.predictions(spark, sf_dir))


@query("confusion_counts", with_views("""
SELECT project, period, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL""", "predictions"))
def q_confusion_counts(spark, sf_dir):
    return R.confusion_counts(fixtures.predictions(spark, sf_dir))


@query("report_by_window", with_views(REPORT_SQL + f"""
SELECT project, scope, period, class, {r('precision')} AS precision, {r('recall')} AS recall,
       {r('f1_score')} AS f1_score, support FROM report""", "predictions"))
def q_report_by_window(spark, sf_dir):
    return rounded(_report(spark, sf_dir))


@query("classification_report", with_views(REPORT_SQL + f"""
SELECT project, class, {r('precision')} AS precision, {r('recall')} AS recall,
       {r('f1_score')} AS f1_score, support FROM report WHERE scope = 'overall'""", "predictions"))
def q_classification_report(spark, sf_dir):
    return rounded(R.classification_report(fixtures.predictions(spark, sf_dir)))


@query("report_averages", with_views(REPORT_SQL + f"""
SELECT project, scope, period, class, {r('precision')} AS precision, {r('recall')} AS recall,
       {r('f1_score')} AS f1_score, support FROM report
WHERE class IN ('accuracy', 'macro avg', 'weighted avg')""", "predictions"))
def q_report_averages(spark, sf_dir):
    return rounded(R.report_averages(_report(spark, sf_dir)))


@query("macro_f1_series", with_views(REPORT_SQL + f"""
SELECT project, period, {r('f1_score')} AS f1_macro FROM report WHERE class = 'macro avg' AND scope = 'window'""",
                                     "predictions"))
def q_macro_f1_series(spark, sf_dir):
    return rounded(R.macro_f1_series(_report(spark, sf_dir)))


def _timeline_sql():
    i = _info_sql("period")
    sy, sm, ey, em = i["start_year"], i["start_month"], i["end_year"], i["end_month"]
    return REPORT_SQL + f""",
series AS (SELECT project, period, f1_score AS f1_macro FROM report WHERE class = 'macro avg' AND scope = 'window'),
d AS (SELECT project, period, f1_macro, CASE WHEN {sy} = {ey} AND {sm} = {em} THEN {sy} + ({sm} - 1) / 12.0 END AS dd
      FROM series)
SELECT project, period, {r('dd')} AS decimal_date, {r('f1_macro')} AS f1_macro,
       printf('%d-%02d', CAST(floor(dd) AS INTEGER),
              CASE WHEN dd = floor(dd) THEN 1 ELSE CAST(floor((dd - floor(dd)) * 12) AS INTEGER) + 1 END) AS display_date
FROM d WHERE dd IS NOT NULL"""


@query("performance_timeline", with_views(_timeline_sql(), "predictions"))
def q_performance_timeline(spark, sf_dir):
    return rounded(R.performance_timeline(R.macro_f1_series(_report(spark, sf_dir))))


@query("report_nested")
def q_report_nested(spark, sf_dir):
    """Export form of the reports (map per window + JSON); rows-only."""
    return R.report_as_nested(_report(spark, sf_dir)).drop("report")


