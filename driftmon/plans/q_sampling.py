"""Queries: deterministic per-class samples and the stratified split."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmon.operators import sampling as SM
from driftmon.plans.catalog import query
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views

SEED = 42
N = 50

_RANKED = f"""
WITH p AS (SELECT issue_id, project, y_true, md5(concat(CAST(issue_id AS VARCHAR), ':{SEED}')) AS h FROM predictions),
c AS (SELECT project, y_true, count(*) AS n_class FROM p GROUP BY ALL),
r AS (SELECT p.*, row_number() OVER (PARTITION BY project, y_true ORDER BY h, issue_id) AS rk FROM p)
"""


def _quota_sql(total: str) -> str:
    """Largest-remainder quotas over classes for a per-project ``total`` (SQL over ``c``)."""
    return f"""
t AS (SELECT c.*, sum(n_class) OVER (PARTITION BY project) AS big_n,
             count(*) OVER (PARTITION BY project) AS k FROM c),
t2 AS (SELECT *, CAST({total} AS BIGINT) AS total FROM t),
t3 AS (SELECT *, (total * n_class) // big_n AS base, (total * n_class) % big_n AS rem FROM t2),
t4 AS (SELECT *, total - sum(base) OVER (PARTITION BY project) AS deficit,
              row_number() OVER (PARTITION BY project ORDER BY rem DESC, y_true) AS rr FROM t3),
q AS (SELECT project, y_true, base + CASE WHEN rr <= deficit THEN 1 ELSE 0 END AS quota FROM t4)"""


def _preds(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).select("issue_id", "project", "y_true")


@query("sample_balanced", with_views(_RANKED + f""",
mc AS (SELECT project, min(n_class) AS mn FROM c GROUP BY project)
SELECT issue_id, project, y_true FROM r JOIN mc USING (project) WHERE rk <= least(mn, {N})""", "predictions"))
def q_sample_balanced(spark, sf_dir):
    return SM.sample_balanced(_preds(spark, sf_dir), "y_true", "issue_id", N, SEED, keys=["project"])


@query("sample_per_class", with_views(_RANKED + f"""
SELECT issue_id, project, y_true FROM r WHERE rk <= {N}""", "predictions"))
def q_sample_per_class(spark, sf_dir):
    return SM.sample_per_class(_preds(spark, sf_dir), "y_true", "issue_id", N, SEED, keys=["project"])


@query("sample_stratified", with_views(_RANKED + "," + _quota_sql(f"least(big_n, k * {N})") + """
SELECT issue_id, project, y_true FROM r JOIN q USING (project, y_true) WHERE rk <= quota""", "predictions"))
def q_sample_stratified(spark, sf_dir):
    return SM.sample_stratified(_preds(spark, sf_dir), "y_true", "issue_id", N, SEED, keys=["project"])


@query("train_validation_split", with_views(_RANKED + "," + _quota_sql("ceil(0.3 * big_n)") + """
SELECT project, y_true, CASE WHEN rk <= quota THEN 'validation' ELSE 'train' END AS split, count(*) AS n,
       CAST(sum(issue_id) AS BIGINT) AS id_sum
FROM r JOIN q USING (project, y_true) GROUP BY ALL""", "predictions"))
def q_train_validation_split(spark, sf_dir):
    s = SM.train_validation_split(_preds(spark, sf_dir), "y_true", "issue_id", 0.3, SEED, keys=["project"])
    return s.groupBy("project", "y_true", "split").agg(F.count(F.lit(1)).alias("n"),
                                                       F.sum("issue_id").cast("bigint").alias("id_sum"))
