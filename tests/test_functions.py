"""Column functions on hand-made frames (labels, dates, periods, text)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftmon.functions import periods as P
from driftmon.functions.dates import is_valid_date, parse_utc, parse_wall_clock
from driftmon.functions.labels import map_label
from driftmon.functions.text import NA_TOKENS, build_text, na_tokens_to_null, normalise_text, strip_unprintable


def one_col(spark, values, name="x", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def test_label_prefix_rule(spark):
    labels = ["Bug", "bug report", "Reporting", "Debug", " bug", "New Feature", "IMPROVEMENT",
              "Question", "Sub-task", ""]
    got = [r.m for r in one_col(spark, labels).select(map_label("x").alias("m")).collect()]
    assert got == ["bug", "bug", "bug", None, None, "feature", "feature", "question", None, None]


def test_valid_dates(spark):
    values = ["2021-12-14T16:45:26.000+0000", "2021-12-14T16:45:26Z", "2021-12-14T16:45:26+0000",
              "2021-12-14", "", "1899-12-31T23:59:59.000+0000", "2021-12-31T23:30:00.000-0500",
              "not a date", "20211214", "2021-13-01"]
    got = [r.v for r in one_col(spark, values).select(is_valid_date("x").alias("v")).collect()]
    assert got == [True, True, True, True, False, False, True, False, True, False]


def test_wall_clock_and_utc_disagree_on_year(spark):
    df = one_col(spark, ["2021-12-31T23:30:00.000-0500"])
    row = df.select(F.year(parse_wall_clock("x")).alias("w"), F.year(parse_utc("x")).alias("u")).first()
    assert (row.w, row.u) == (2021, 2022)


def test_wall_clock_without_fraction_parses(spark):
    df = one_col(spark, ["2021-12-14T16:45:26+0000", "not a date"])
    got = [r.t for r in df.select(parse_wall_clock("x").alias("t")).collect()]
    assert got[0] == dt.datetime(2021, 12, 14, 16, 45, 26) and got[1] is None


def _key(spark, ts, split, n):
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    return [r.k for r in df.select(P.period_key("t", split, n).alias("k")).collect()]


def brute_key(t: dt.datetime, split: str, n: int) -> str:
    """Plain-Python statement of the window rule (floor modulo, zero-anchored)."""
    if split == "year":
        base = t.year
    elif split == "month":
        base = t.year * 12 + t.month - 1
    else:
        base = (t - dt.datetime(1970, 1, 1)).days
    s = base - base % n
    e = s + n - 1
    if split == "year":
        return f"{s}_{e}"
    if split == "month":
        return f"{s // 12}-{s % 12 + 1:02d}_{e // 12}-{e % 12 + 1:02d}"
    d0 = dt.datetime(1970, 1, 1)
    return f"{(d0 + dt.timedelta(days=s)):%Y-%m-%d}_{(d0 + dt.timedelta(days=e)):%Y-%m-%d}"


def test_period_keys(spark):
    ts = [dt.datetime(2009, 12, 31, 23), dt.datetime(2010, 1, 1), dt.datetime(1969, 12, 30),
          dt.datetime(1960, 2, 29, 12), dt.datetime(2000, 6, 15)]
    for split, n in [("year", 1), ("year", 5), ("month", 1), ("month", 3), ("month", 5), ("day", 1), ("day", 7)]:
        assert _key(spark, ts, split, n) == [brute_key(t, split, n) for t in ts], (split, n)
    assert _key(spark, ts, "year", 5)[:2] == ["2005_2009", "2010_2014"]
    assert _key(spark, ts, "day", 7)[2] == "1969-12-25_1969-12-31"


def test_parse_and_format_period(spark):
    df = one_col(spark, ["2000_2001", "2000-11_2001-01.csv", "2000-01-01_2000-01-07", "junk"], "period")
    rows = df.select(P.parse_period("period").alias("p"), P.format_period("period").alias("f"),
                     P.period_short("period").alias("s")).collect()
    assert (rows[0].p.start, rows[0].p.end, rows[0].f, rows[0].s) == (
        dt.date(2000, 1, 1), dt.date(2001, 12, 31), "2000-2001", "2000")
    assert (rows[1].p.start, rows[1].p.end, rows[1].f) == (dt.date(2000, 11, 1), dt.date(2001, 1, 31),
                                                          "2000-11 to 2001-01")
    assert rows[2].p.split_type == "day" and rows[2].s == "2000-01-01"
    assert rows[3].p.split_type is None


def test_decimal_year_branches(spark):
    labels = ["2000-01_2000-01", "2000-07_2000-07", "2000_2000", "2000-01_2000-12", "1999-01_2000-12",
              "2000_02_30-2000_03_01", "bad"]
    df = one_col(spark, labels, "period").withColumn("_i", P.extract_date_info("period"))
    got = [r.d for r in df.select(P.decimal_year("_i").alias("d")).collect()]
    assert got[0] == 2000.0 and abs(got[1] - 2000.5) < 1e-12 and got[2] == 2000.0 and got[3] == 2000.0
    # midpoint of 1999-01-01 and 2000-12-31 as a year fraction
    mid = dt.datetime(1999, 1, 1) + (dt.datetime(2000, 12, 31) - dt.datetime(1999, 1, 1)) / 2
    y0 = dt.datetime(mid.year, 1, 1)
    expect = mid.year + (mid - y0).total_seconds() / (dt.datetime(mid.year + 1, 1, 1) - y0).total_seconds()
    assert abs(got[4] - expect) < 1e-9
    assert abs(got[5] - (2000 + 1 / 12)) < 1e-12  # impossible date falls back to the start month
    assert got[6] is None


def test_text_helpers(spark):
    df = spark.createDataFrame([("a\nb\tc d e\u0000", None, "  x  "), ("t", "b", None)], "a string, b string, c string")
    row = df.select(strip_unprintable("a").alias("s"), build_text("c", "b").alias("t"),
                    normalise_text("c").alias("n")).collect()
    assert row[0].s == "abcd e" and row[0].t == "" and row[0].n == "x"
    assert row[1].t == ""  # a null part empties the text
    nas = spark.createDataFrame([(t,) for t in NA_TOKENS] + [("ok",)], "x string")
    assert nas.select(na_tokens_to_null("x").alias("x")).where("x IS NOT NULL").count() == 1


def test_dates_are_parsed_once(spark):
    from driftmon.operators import windows as W

    df = spark.createDataFrame([("2020-05-06T07:08:09.5+0200", "a", "b", "c")], "date string, title string, body string, label string")
    frame = W.load_model_frame(W.create_time_windows(df, "month", 3), W.target_window("year", 2020, 2020), "month")
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract(") == 0 and plan.count("rlike") == 1
    row = frame.first()
    assert str(row.date) == "2020-05-06 07:08:09" and row.period == "2020-04_2020-06" and row.text == "a b"


def test_utc_of_every_written_form(spark):
    forms = {"2020-01-01": "2020-01-01 00:00:00", "20200101": "2020-01-01 00:00:00", "2020-01-01T05": "2020-01-01 05:00:00",
             "2020-01-01 05:06Z": "2020-01-01 05:06:00", "20200101T050607,25-0130": "2020-01-01 06:36:07.25",
             "2020-01-01T05:06:07.123456789+05": "2020-01-01 00:06:07.123456", "2020-13-01": None, "2020-1-1": None,
             "2020-01-01T05:06:07+": None, "": None}
    df = spark.createDataFrame([(x,) for x in forms] + [(None,)], "x string")
    got = {r.x: r.u for r in df.select("x", parse_utc("x").cast("string").alias("u")).collect()}
    assert got == {**forms, None: None}
