"""Queries: window labels, window selection, model frames, label ids, window files."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmon.functions import periods as P
from driftmon.functions.labels_index import index_labels, label_dictionary
from driftmon.functions.text import build_text, normalise_text, row_text_fallback
from driftmon.operators import windows as W
from driftmon.plans import sql_snippets as S
from driftmon.plans.catalog import query
from driftmon.plans.q_prepare import mapped_issues, windowed
from driftmon.session import scratch_path
from driftmon.sources import fixtures, issues_io
from driftmon.sources.fixtures import with_views

TRAIN_MONTHS = W.target_window("month", 1996, 1997, 1, 6)
TRAIN_YEARS = W.target_window("year", 1995, 1996)


def _all_labels_spark(spark, sf_dir):
    parts = [windowed(spark, sf_dir, s, n).select("period").distinct()
             for s, n in (("year", 1), ("month", 3), ("day", 7))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def _all_labels_sql():
    parts = [f"SELECT DISTINCT period FROM ({S.windowed_issues(s, n)}) w{i}"
             for i, (s, n) in enumerate((("year", 1), ("month", 3), ("day", 7)))]
    return " UNION ".join(parts)


@query("parse_period", with_views(f"""
SELECT period, {S.split_type_of("period")} AS split_type,
       strftime({S.period_start("period")}, '%Y-%m-%d') AS period_start,
       strftime({S.period_end("period")}, '%Y-%m-%d') AS period_end,
       CASE {S.split_type_of("period")}
         WHEN 'year' THEN printf('%d-%d', year({S.period_start("period")}), year({S.period_end("period")}))
         WHEN 'month' THEN strftime({S.period_start("period")}, '%Y-%m') || ' to ' || strftime({S.period_end("period")}, '%Y-%m')
         ELSE strftime({S.period_start("period")}, '%Y-%m-%d') || ' to ' || strftime({S.period_end("period")}, '%Y-%m-%d') END AS display,
       CASE {S.split_type_of("period")}
         WHEN 'year' THEN CAST(year({S.period_start("period")}) AS VARCHAR)
         WHEN 'month' THEN strftime({S.period_start("period")}, '%Y-%m')
         ELSE strftime({S.period_start("period")}, '%Y-%m-%d') END AS period_short
FROM ({_all_labels_sql()}) l""", "issues"))
def q_parse_period(spark, sf_dir):
    labels = P.with_parsed_period(_all_labels_spark(spark, sf_dir), "period", "_p")
    p = F.col("_p")
    return labels.select(
        "period", p.split_type.alias("split_type"),
        F.date_format(p.start, "yyyy-MM-dd").alias("period_start"),
        F.date_format(p.end, "yyyy-MM-dd").alias("period_end"),
        P.format_period("period").alias("display"),
        P.period_short("period").alias("period_short"),
    )


def _counts_sql(where: str, split_type="month", n=1):
    return with_views(f"""
SELECT project, period, count(*) AS n FROM ({S.windowed_issues(split_type, n)}) w
WHERE {where} GROUP BY project, period""", "issues")


def _counts(df):
    return df.groupBy("project", "period").agg(F.count(F.lit(1)).alias("n"))


@query("train_windows", _counts_sql(
    f"{S.period_start('period')} <= DATE '{TRAIN_MONTHS[1]}' AND {S.period_end('period')} >= DATE '{TRAIN_MONTHS[0]}'",
    "month", 3))
def q_train_windows(spark, sf_dir):
    return _counts(W.train_windows(windowed(spark, sf_dir, "month", 3), TRAIN_MONTHS))


@query("test_windows_strict", _counts_sql(f"{S.period_start('period')} > DATE '{TRAIN_MONTHS[1]}'"))
def q_test_windows_strict(spark, sf_dir):
    return _counts(W.test_windows(windowed(spark, sf_dir, "month", 1), TRAIN_MONTHS, "month", rule="similarity"))


@query("test_windows_inclusive", _counts_sql(
    f"{S.period_start('period')} >= DATE '{TRAIN_MONTHS[1].replace(day=1)}'"))
def q_test_windows_inclusive(spark, sf_dir):
    return _counts(W.test_windows(windowed(spark, sf_dir, "month", 1), TRAIN_MONTHS, "month", rule="evaluation"))


@query("test_windows_year", _counts_sql(f"{S.period_start('period')} > DATE '{TRAIN_YEARS[1]}'", "year", 1))
def q_test_windows_year(spark, sf_dir):
    return _counts(W.test_windows(windowed(spark, sf_dir, "year", 1), TRAIN_YEARS, "year"))


EXACT = W.target_window("month", 1998, 1998, 3, 3)


@query("exact_window", _counts_sql(
    f"{S.period_start('period')} = DATE '{EXACT[0]}' AND {S.period_end('period')} = DATE '{EXACT[1]}'"))
def q_exact_window(spark, sf_dir):
    return _counts(W.exact_window(windowed(spark, sf_dir, "month", 1), EXACT))


_NA_CELLS = ", ".join(S.q(t) for t in (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null"))


def _cell(c: str) -> str:
    return f"CASE WHEN {c} IN ({_NA_CELLS}) THEN NULL ELSE {c} END"


def _odd_cells(spark, sf_dir):
    """Windows in which some titles, bodies and labels are empty or spell a missing value."""
    n = F.length(F.coalesce("body", F.lit("")))
    return windowed(spark, sf_dir, "year", 1).withColumns({
        "title": F.when(n % 7 == 0, "NA").when(n % 7 == 1, "").otherwise(F.col("title")),
        "label": F.when(n % 11 == 0, "null").otherwise(F.col("label")),
        "body": F.when(n % 5 == 0, "").when(n % 5 == 1, "n/a").otherwise(F.col("body"))})


@query("model_frame_missing_cells", with_views(f"""
WITH w AS (SELECT *, length(coalesce(body, '')) AS n FROM ({S.windowed_issues("year", 1)}) w0),
odd AS (SELECT project, period, CASE WHEN n % 7 = 0 THEN 'NA' WHEN n % 7 = 1 THEN '' ELSE title END AS title,
               CASE WHEN n % 11 = 0 THEN 'null' ELSE label END AS label,
               CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 = 1 THEN 'n/a' ELSE body END AS body FROM w),
cells AS (SELECT project, period, {_cell("label")} AS label, {_cell("title")} AS title, {_cell("body")} AS body FROM odd)
SELECT project, period, label, CASE label WHEN 'bug' THEN 0 ELSE 1 END AS label_id, coalesce(title || ' ' || body, '') AS text
FROM cells
WHERE {S.period_start('period')} <= DATE '{TRAIN_YEARS[1]}' AND {S.period_end('period')} >= DATE '{TRAIN_YEARS[0]}'
  AND label IN ('bug', 'feature')""", "issues"))
def q_model_frame_missing_cells(spark, sf_dir):
    """Missing cells, label ids and the range check of the model frame."""
    f = W.load_model_frame(_odd_cells(spark, sf_dir), TRAIN_YEARS, "year", labels=["bug", "feature"], label_ids=True,
                           require_rows=True)
    return f.select("project", "period", "label", "label_id", "text")


@query("model_frame", with_views(f"""
SELECT project, period, label, coalesce({_cell("title")} || ' ' || {_cell("body")}, '') AS text,
       strftime(date, '%Y-%m-%d %H:%M:%S') AS date
FROM ({S.windowed_issues("year", 1)}) w
WHERE {S.period_start('period')} <= DATE '{TRAIN_YEARS[1]}' AND {S.period_end('period')} >= DATE '{TRAIN_YEARS[0]}'
  AND label IN ('bug', 'feature')""", "issues"))
def q_model_frame(spark, sf_dir):
    f = W.load_model_frame(windowed(spark, sf_dir, "year", 1), TRAIN_YEARS, "year", labels=["bug", "feature"])
    return f.select("project", "period", "label", "text",
                    F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def _info_sql(x: str) -> dict:
    """DuckDB: the six date parts of a window label, one CASE per part and shape."""
    specs = [("y1", "c1", "c1", "y2", "c12", "c31"), ("y1", "m2", "c1", "y3", "m4", None),
             ("y1", "m2", "c1", "y3", "m4", None), ("y1", "m2", "d3", "y4", "m5", "d6"),
             ("y1", "c1", "c1", "y2", "c12", "c31"), ("y1", "m2", "d3", "y4", "m5", "d6")]
    fields = {f: [] for f in P.INFO_FIELDS}
    for pattern, spec in zip(P.INFO_PATTERNS, specs):
        for field, src in zip(P.INFO_FIELDS, spec):
            if src is None:
                v = "NULL"
            elif src.startswith("c"):
                v = src[1:]
            else:
                v = S._g(x, pattern, int(src[1:]))
            fields[field].append(f"WHEN regexp_matches({x}, {S.q(pattern)}) THEN {v}")
    return {f: "(CASE " + " ".join(arms) + " END)" for f, arms in fields.items()}


def _decimal_year_sql() -> str:
    i = _info_sql("period")
    sy, sm, ey, em = i["start_year"], i["start_month"], i["end_year"], i["end_month"]
    sd = f"coalesce({i['start_day']}, 1)"
    ed = f"coalesce({i['end_day']}, CASE WHEN {em} = 2 THEN 28 WHEN {em} IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"
    st = f"try_strptime(printf('%04d-%02d-%02d', {sy}, {sm}, {sd}), '%Y-%m-%d')"
    en = f"try_strptime(printf('%04d-%02d-%02d', {ey}, {em}, {ed}), '%Y-%m-%d')"
    return f"""
WITH l AS ({_all_labels_sql()} UNION SELECT DISTINCT period FROM predictions),
p AS (SELECT period, {sy} AS sy, {sm} AS sm, {ey} AS ey, {em} AS em, {st} AS st, {en} AS en FROM l),
m AS (SELECT *, (epoch(st) + epoch(en)) / 2.0 AS mid FROM p),
y AS (SELECT *, year(to_timestamp(mid)) AS my FROM m)
SELECT period,
  CASE WHEN sy IS NULL THEN NULL
       WHEN sy = ey AND sm = em THEN sy + (sm - 1) / 12.0
       WHEN sy = ey AND sm = 1 AND em = 12 THEN CAST(sy AS DOUBLE)
       WHEN st IS NULL OR en IS NULL THEN sy + (sm - 1) / 12.0
       ELSE my + (mid - epoch(make_timestamp(my, 1, 1, 0, 0, 0)))
                 / (epoch(make_timestamp(my + 1, 1, 1, 0, 0, 0)) - epoch(make_timestamp(my, 1, 1, 0, 0, 0))) END
  AS decimal_year
FROM y"""


@query("decimal_year", with_views(_decimal_year_sql(), "issues", "predictions"))
def q_decimal_year(spark, sf_dir):
    labels = _all_labels_spark(spark, sf_dir).unionByName(
        fixtures.predictions(spark, sf_dir).select("period").distinct()).distinct()
    info = labels.withColumn("_info", P.extract_date_info("period"))
    return info.select("period", P.decimal_year("_info").alias("decimal_year"))


@query("period_year_align", with_views("""
SELECT period, TRY_CAST(regexp_extract(period, '(\\d{4})', 1) AS INTEGER) AS year,
       split_part(regexp_replace(period, '\\.csv$', ''), '_', 2) AS aligned
FROM (SELECT DISTINCT period FROM predictions) p""", "predictions"))
def q_period_year_align(spark, sf_dir):
    p = fixtures.predictions(spark, sf_dir).select("period").distinct()
    return p.select("period", P.period_year("period").alias("year"), P.align_period("period", 1).alias("aligned"))


@query("index_labels", with_views(f"""
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, n
FROM (SELECT label, count(*) AS n FROM ({S.MAPPED_ISSUES}) m GROUP BY label) c""", "issues"))
def q_index_labels(spark, sf_dir):
    m = mapped_issues(spark, sf_dir)
    d = label_dictionary(m)
    return index_labels(m, d).groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("n"))


@query("write_read_windows", _counts_sql(f"{S.period_start('period')} > DATE '1999-12-31'"))
def q_write_read_windows(spark, sf_dir):
    path = scratch_path(spark, "windows")
    issues_io.write_windows(windowed(spark, sf_dir, "month", 1), path)
    back = issues_io.read_windows(spark, path, "month", 1)
    return _counts(W.test_windows(back, W.target_window("year", 1999, 1999), "month"))


@query("discover_projects", with_views(f"""
SELECT project, count(DISTINCT period) AS n_windows FROM ({S.windowed_issues("month", 1)}) w GROUP BY project""",
                                       "issues"))
def q_discover_projects(spark, sf_dir):
    path = scratch_path(spark, "windows")
    issues_io.write_windows(windowed(spark, sf_dir, "month", 1), path)
    found = issues_io.discover_projects(issues_io.read_windows(spark, path))
    return found.groupBy("project").agg(F.countDistinct("period").alias("n_windows"))


@query("text_columns", with_views(f"""
SELECT project,
  count(*) FILTER (WHERE coalesce(title || ' ' || body, '') = '') AS n_empty_text,
  CAST(sum(length(coalesce(title || ' ' || body, ''))) AS BIGINT) AS text_chars,
  count(*) FILTER (WHERE {S.normalise_text("body")} = '') AS n_empty_body,
  CAST(sum(length({S.normalise_text("body")})) AS BIGINT) AS body_chars,
  CAST(sum(length(regexp_replace({S.normalise_text("title")} || ' ' || {S.normalise_text("body")},
       {S.q(S.WHITESPACE_RE2)}, '', 'g'))) AS BIGINT) AS fallback_chars
FROM issues GROUP BY project""", "issues"))
def q_text_columns(spark, sf_dir):
    i = fixtures.issues(spark, sf_dir)
    t = i.select("project", build_text("title", "body").alias("text"),
                 normalise_text("body").alias("nb"), row_text_fallback("title", "body").alias("fb"))
    return t.groupBy("project").agg(
        F.count_if(F.col("text") == "").alias("n_empty_text"),
        F.sum(F.length("text")).cast("bigint").alias("text_chars"),
        F.count_if(F.col("nb") == "").alias("n_empty_body"),
        F.sum(F.length("nb")).cast("bigint").alias("body_chars"),
        F.sum(F.length("fb")).cast("bigint").alias("fallback_chars"),
    )
