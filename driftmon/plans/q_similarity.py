"""Queries: mean / max cosine similarity of test windows to the training text."""

from __future__ import annotations

from driftmon.operators import similarity as SIM
from driftmon.operators import windows as W
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import query
from driftmon.plans.rounding import r, rounded
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views

TRAIN = W.target_window("year", 1995, 1996)


def split_vectors(spark, sf_dir):
    v = fixtures.vectors(spark, sf_dir)
    return W.test_windows(v, TRAIN, "month", rule="similarity"), W.train_windows(v, TRAIN)


def _per_row_sql(agg: str) -> str:
    cos = ("CASE WHEN list_dot_product(te.embedding, te.embedding) > 0 "
           "AND list_dot_product(tr.embedding, tr.embedding) > 0 "
           "THEN list_dot_product(te.embedding, tr.embedding) / (sqrt(list_dot_product(te.embedding, te.embedding)) "
           "* sqrt(list_dot_product(tr.embedding, tr.embedding))) ELSE 0 END")
    return f"""
WITH tr AS (SELECT * FROM vectors WHERE {S.period_start('period')} <= DATE '{TRAIN[1]}'
                                    AND {S.period_end('period')} >= DATE '{TRAIN[0]}'),
te AS (SELECT * FROM vectors WHERE {S.period_start('period')} > DATE '{TRAIN[1]}'),
per_row AS (SELECT te.project, te.period, te.vec_id, {agg}({cos}) AS sim
            FROM te JOIN tr ON te.project = tr.project GROUP BY te.project, te.period, te.vec_id)
"""


def _dist_sql() -> str:
    cols = [("avg(sim)", "dist_mean"), ("stddev_pop(sim)", "dist_std"), ("min(sim)", "dist_min"),
            ("quantile_cont(sim, 0.1)", "dist_p10"), ("quantile_cont(sim, 0.25)", "dist_p25"),
            ("quantile_cont(sim, 0.5)", "dist_median"), ("quantile_cont(sim, 0.75)", "dist_p75"),
            ("quantile_cont(sim, 0.9)", "dist_p90"), ("max(sim)", "dist_max")]
    return ", ".join(f"{r(e)} AS {n}" for e, n in cols)


def _avg_sim(mode):
    agg = "avg" if mode == "mean" else "max"
    sql = with_views(_per_row_sql(agg) + f"""
SELECT project, count(*) AS num_samples, {r('avg(sim)')} AS similarity FROM per_row GROUP BY project""",
                     "vectors")

    def run(spark, sf_dir):
        test, train = split_vectors(spark, sf_dir)
        return rounded(SIM.average_similarity(test, train, mode))

    return sql, run


def _dist(mode):
    agg = "avg" if mode == "mean" else "max"
    sql = with_views(_per_row_sql(agg) + f"""
SELECT project, count(*) AS num_samples, {_dist_sql()} FROM per_row GROUP BY project""", "vectors")

    def run(spark, sf_dir):
        test, train = split_vectors(spark, sf_dir)
        return rounded(SIM.similarity_distribution(test, train, mode))

    return sql, run


def _by_period(mode):
    agg = "avg" if mode == "mean" else "max"
    sql = with_views(_per_row_sql(agg) + f"""
SELECT project, period, count(*) AS num_samples, {r('avg(sim)')} AS similarity, {_dist_sql()}
FROM per_row GROUP BY project, period""", "vectors")

    def run(spark, sf_dir):
        test, train = split_vectors(spark, sf_dir)
        return rounded(SIM.similarity_by_period(test, train, mode))

    return sql, run


for _mode in SIM.MODES:
    _sql, _fn = _avg_sim(_mode)
    query(f"average_similarity_{_mode}", _sql)(_fn)
    _sql, _fn = _dist(_mode)
    query(f"similarity_distribution_{_mode}", _sql)(_fn)
    _sql, _fn = _by_period(_mode)
    query("similarity_by_period" if _mode == "mean" else "similarity_by_period_max", _sql)(_fn)
