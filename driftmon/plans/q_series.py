"""Queries: similarity vs quality series, deltas, scaling, correlation, normality, DTW."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmon.functions.periods import period_year
from driftmon.operators import dtw as D
from driftmon.operators import report as R
from driftmon.operators import series as SE
from driftmon.operators import similarity as SIM
from driftmon.operators import stats as ST
from driftmon.plans.catalog import query
from driftmon.plans.q_reports import REPORT_SQL
from driftmon.plans.q_similarity import _per_row_sql, split_vectors
from driftmon.plans.rounding import r, rounded
from driftmon.plans.sql_normality import correlation_p, long_ctes, normality_ctes, quantile_ctes
from driftmon.sources import fixtures
from driftmon.sources.fixtures import with_views


def macro_f1(spark, sf_dir):
    return R.macro_f1_series(R.report_by_window(fixtures.predictions(spark, sf_dir)))


def paired(spark, sf_dir):
    """Similarity (mean mode) per test window joined with macro F1 per window."""
    test, train = split_vectors(spark, sf_dir)
    sim = SIM.similarity_by_period(test, train, "mean", include_distribution=False)
    return SE.join_similarity_performance(sim, macro_f1(spark, sf_dir))


PAIRED_SQL = REPORT_SQL.rstrip() + ",\n" + _per_row_sql("avg").strip()[len("WITH"):] + """,
sim AS (SELECT project, period, count(*) AS num_samples, avg(sim) AS similarity FROM per_row GROUP BY ALL),
f1 AS (SELECT project, period, f1_score AS f1_macro FROM report WHERE class = 'macro avg' AND scope = 'window'),
paired AS (SELECT * FROM sim JOIN f1 USING (project, period))
"""


def _sql(body: str) -> str:
    return with_views(PAIRED_SQL + body, "predictions", "vectors")


@query("similarity_vs_f1", _sql(f"""
SELECT project, period, num_samples, {r('similarity')} AS similarity, {r('f1_macro')} AS f1_macro FROM paired"""))
def q_similarity_vs_f1(spark, sf_dir):
    return rounded(paired(spark, sf_dir))


@query("period_deltas", _sql(f"""
SELECT project, period,
  {r('coalesce(similarity - lag(similarity) OVER (PARTITION BY project ORDER BY period), 0)')} AS similarity_delta,
  {r('coalesce(f1_macro - lag(f1_macro) OVER (PARTITION BY project ORDER BY period), 0)')} AS f1_macro_delta
FROM paired"""))
def q_period_deltas(spark, sf_dir):
    d = SE.period_deltas(paired(spark, sf_dir), ["similarity", "f1_macro"])
    return rounded(d.select("project", "period", "similarity_delta", "f1_macro_delta"))


@query("minmax_scale", _sql(f"""
SELECT project, period,
  {r('coalesce((similarity - min(similarity) OVER w) / nullif(max(similarity) OVER w - min(similarity) OVER w, 0), 0)')}
    AS similarity_normalized,
  {r('coalesce((f1_macro - min(f1_macro) OVER w) / nullif(max(f1_macro) OVER w - min(f1_macro) OVER w, 0), 0)')}
    AS f1_macro_normalized
FROM paired WINDOW w AS (PARTITION BY project)"""))
def q_minmax_scale(spark, sf_dir):
    d = SE.minmax_scale(paired(spark, sf_dir), ["similarity", "f1_macro"])
    return rounded(d.select("project", "period", "similarity_normalized", "f1_macro_normalized"))


@query("zscore_scale", _sql(f"""
SELECT project, period,
  {r('coalesce((similarity - avg(similarity) OVER w) / nullif(stddev_pop(similarity) OVER w, 0), 0)')}
    AS similarity_zscore,
  {r('coalesce((f1_macro - avg(f1_macro) OVER w) / nullif(stddev_pop(f1_macro) OVER w, 0), 0)')}
    AS f1_macro_zscore
FROM paired WINDOW w AS (PARTITION BY project)"""))
def q_zscore_scale(spark, sf_dir):
    d = SE.zscore_scale(paired(spark, sf_dir), ["similarity", "f1_macro"])
    return rounded(d.select("project", "period", "similarity_zscore", "f1_macro_zscore"))


_R_SQL = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("pearson_r", _sql(f"""
SELECT project, count(*) AS n, {r(_R_SQL.format(x='similarity', y='f1_macro'))} AS r FROM paired GROUP BY project"""))
def q_pearson_r(spark, sf_dir):
    return rounded(ST.pearson(paired(spark, sf_dir), "similarity", "f1_macro", with_p=False))


_RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY similarity)
                     + (count(*) OVER (PARTITION BY {g}, similarity) - 1) / 2.0 AS rx,
                     rank() OVER (PARTITION BY {g} ORDER BY f1_macro)
                     + (count(*) OVER (PARTITION BY {g}, f1_macro) - 1) / 2.0 AS ry FROM {src})"""


@query("spearman_r", _sql(f""", {_RANKS.format(g='project', src='paired')}
SELECT project, count(*) AS n, {r(_R_SQL.format(x='rx', y='ry'))} AS r FROM ranked GROUP BY project"""))
def q_spearman_r(spark, sf_dir):
    return rounded(ST.spearman(paired(spark, sf_dir), "similarity", "f1_macro", with_p=False))


@query("yearly_spearman_r", _sql(f""",
y AS (SELECT *, TRY_CAST(regexp_extract(period, '(\\d{{4}})', 1) AS INTEGER) AS year FROM paired),
yk AS (SELECT * FROM y WHERE (project, year) IN (SELECT project, year FROM y GROUP BY ALL HAVING count(*) >= 3)),
{_RANKS.format(g='project, year', src='yk')}
SELECT project, year, count(*) AS n, {r(_R_SQL.format(x='rx', y='ry'))} AS r FROM ranked GROUP BY project, year"""))
def q_yearly_spearman_r(spark, sf_dir):
    p = paired(spark, sf_dir).withColumn("year", period_year("period"))
    counts = p.groupBy("project", "year").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    kept = p.join(counts.drop("_n"), ["project", "year"], "left_semi")
    return rounded(ST.spearman(kept, "similarity", "f1_macro", keys=["project", "year"], with_p=False))


@query("density_histogram", with_views(REPORT_SQL + f""",
hv AS (SELECT project, f1_score AS v FROM report WHERE class = 'macro avg' AND scope = 'window'),
st AS (SELECT project, count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
              quantile_cont(v, 0.75) AS q3 FROM hv GROUP BY project),
w AS (SELECT *, hi - lo AS span,
             least(greatest(2 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1))
             AS width FROM st),
b AS (SELECT project, n, CASE WHEN width > 0 THEN CAST(ceil(span / width) AS INTEGER) ELSE 1 END AS bins,
             CASE WHEN span = 0 THEN lo - 0.5 ELSE lo END AS first,
             CASE WHEN span = 0 THEN hi + 0.5 ELSE hi END AS last FROM w),
c AS (SELECT hv.project, least(CAST(floor((v - first) * bins / (last - first)) AS INTEGER), bins - 1) AS bin,
             count(*) AS cnt FROM hv JOIN b USING (project) GROUP BY ALL),
allb AS (SELECT project, n, bins, first, last, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM b)
SELECT project, bin, {r('first + bin * (last - first) / bins')} AS bin_left,
       {r('first + (bin + 1) * (last - first) / bins')} AS bin_right,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       {r('coalesce(cnt, 0) / (n * (last - first) / bins)')} AS density
FROM allb LEFT JOIN c USING (project, bin)""", "predictions"))
def q_density_histogram(spark, sf_dir):
    return rounded(ST.density_histogram(macro_f1(spark, sf_dir), "f1_macro"))


def _correlations(src: str, x: str, y: str, g: str = "project") -> str:
    """CTEs ``pearson`` and ``spearman``: n and r by ``g`` of the rows of ``src`` that have both values."""
    rank = f"rank() OVER (PARTITION BY {g} ORDER BY {{c}}) + (count(*) OVER (PARTITION BY {g}, {{c}}) - 1) / 2.0"
    return f"""both_values AS (SELECT {g}, {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
average_ranks AS (SELECT {g}, {rank.format(c='x')} AS x, {rank.format(c='y')} AS y FROM both_values),
pearson AS (SELECT {g}, count(*) AS n, {_R_SQL.format(x='x', y='y')} AS r FROM both_values GROUP BY {g}),
spearman AS (SELECT {g}, count(*) AS n, {_R_SQL.format(x='x', y='y')} AS r FROM average_ranks GROUP BY {g})"""


@query("correlation_test", _sql(f""", {_correlations('paired', 'similarity', 'f1_macro')}
SELECT project, n, {r('r')} AS r, {r(correlation_p('r', 'n'))} AS p, 'Pearson' AS method FROM pearson
UNION ALL SELECT project, n, {r('r')}, {r(correlation_p('r', 'n'))}, 'Spearman' FROM spearman"""))
def q_correlation_test(spark, sf_dir):
    p = paired(spark, sf_dir)
    a = ST.pearson(p, "similarity", "f1_macro").withColumn("method", F.lit("Pearson"))
    b = ST.spearman(p, "similarity", "f1_macro").withColumn("method", F.lit("Spearman"))
    return rounded(a.unionByName(b))


_SCALED = """scaled AS (SELECT project, period,
  coalesce((similarity - min(similarity) OVER w) / nullif(max(similarity) OVER w - min(similarity) OVER w, 0), 0)
    AS similarity_normalized,
  coalesce((f1_macro - min(f1_macro) OVER w) / nullif(max(f1_macro) OVER w - min(f1_macro) OVER w, 0), 0)
    AS f1_macro_normalized
FROM paired WINDOW w AS (PARTITION BY project))"""
_SCALED_COLS = ["similarity_normalized", "f1_macro_normalized"]
_CRITICAL = ", ".join(f"round({c} / (1 + 4.0 / n - 25.0 / n / n), 3)" for c in (0.576, 0.656, 0.787, 0.918, 1.092))


@query("check_normality", _sql(f""", {_SCALED}, {normality_ctes('scaled', _SCALED_COLS)}
SELECT project, variable, n, {r('w')} AS shapiro_statistic, {r('p')} AS shapiro_p_value, {r('a2')} AS anderson_statistic,
       CASE WHEN a2 IS NULL THEN CAST([] AS DOUBLE[]) ELSE CAST([{_CRITICAL}] AS DOUBLE[]) END AS anderson_critical_values,
       CAST([15.0, 10.0, 5.0, 2.5, 1.0] AS DOUBLE[]) AS anderson_significance_levels, is_normal FROM normality"""))
def q_check_normality(spark, sf_dir):
    p = SE.minmax_scale(paired(spark, sf_dir), ["similarity", "f1_macro"])
    return rounded(ST.check_normality(p, ["similarity_normalized", "f1_macro_normalized"]))


_MEDIAN = "(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END)"


@query("qq_points", _sql(f""", {long_ctes('paired', ['similarity', 'f1_macro'], 'project')},
{quantile_ctes('ranked', _MEDIAN, 'plot')},
line AS (SELECT *, avg(x) OVER a AS mx, avg(v) OVER a AS my, covar_pop(x, v) OVER a / var_pop(x) OVER a AS slope,
                covar_pop(x, v) OVER a / (stddev_pop(x) OVER a * stddev_pop(v) OVER a) AS r
         FROM plot6 WINDOW a AS (PARTITION BY project, variable))
SELECT project, variable, i, {r('x')} AS theoretical, {r('v')} AS "ordered",
       CASE WHEN n > 1 THEN {r('CASE WHEN lo = hi THEN 0 ELSE slope END')} END AS slope,
       CASE WHEN n > 1 THEN {r('CASE WHEN lo = hi THEN my ELSE my - slope * mx END')} END AS intercept,
       CASE WHEN n > 1 THEN {r('CASE WHEN lo = hi THEN 0 ELSE r END')} END AS r FROM line"""))
def q_qq_points(spark, sf_dir):
    return rounded(ST.qq_points(paired(spark, sf_dir), ["similarity", "f1_macro"]))


def _auto_sql(src: str, x: str, y: str, g: str = "project") -> str:
    """CTE ``chosen``: the automatic test of ``src`` by ``g``."""
    flag = "bool_or(is_normal) FILTER (WHERE variable = '{v}')"
    return f"""{normality_ctes(src, [x, y], g)},
{_correlations(src, x, y, g)},
flags AS (SELECT {g}, {flag.format(v=x)} AND {flag.format(v=y)} AS normal FROM normality GROUP BY {g}),
chosen AS (SELECT {g}, CASE WHEN normal THEN 'Pearson' ELSE 'Spearman' END AS test_method,
                  CASE WHEN normal THEN pearson.r ELSE spearman.r END AS r, pearson.n AS n
           FROM flags JOIN pearson USING ({g}) JOIN spearman USING ({g})),
test_rows AS (SELECT {g}, test_method, {r('r')} AS correlation_coefficient, {r(correlation_p('r', 'n'))} AS p_value,
                     n AS sample_size, {correlation_p('r', 'n')} < 0.05 AS is_significant,
                     CAST(0.05 AS DOUBLE) AS significance_level FROM chosen)"""


AUTO_TEST_SQL = _sql(f""", {_SCALED}, {_auto_sql('scaled', *_SCALED_COLS)}
SELECT * FROM test_rows""")


@query("auto_correlation_test", AUTO_TEST_SQL)
def q_auto_correlation_test(spark, sf_dir):
    p = SE.minmax_scale(paired(spark, sf_dir), ["similarity", "f1_macro"])
    return rounded(ST.auto_correlation_test(p, "similarity_normalized", "f1_macro_normalized"))


@query("yearly_correlation", _sql(f""",
dated AS (SELECT *, TRY_CAST(regexp_extract(period, '(\\d{{4}})', 1) AS INTEGER) AS year FROM paired),
of_year AS (SELECT * FROM dated QUALIFY count(*) OVER (PARTITION BY project, year) >= 3),
{_auto_sql('of_year', 'similarity', 'f1_macro', 'project, year')}
SELECT * FROM test_rows"""))
def q_yearly_correlation(spark, sf_dir):
    return rounded(ST.yearly_correlation(paired(spark, sf_dir), "similarity", "f1_macro"))


# ---- rows-only: a warping path has no SQL form (tested against brute force in tests/)

@query("dtw_align")
def q_dtw_align(spark, sf_dir):
    return D.dtw_align(paired(spark, sf_dir), "similarity", "f1_macro")
