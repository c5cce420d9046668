"""Calendar windows over issues and the choice of train / test windows.

Windows are a column (``period``), not files: one write partitioned by
``split_type, range, project, period`` replaces the reference's one CSV per
window, and choosing windows is a predicate on the parsed period, which the
parquet reader turns into partition pruning.
"""

from __future__ import annotations

import datetime as dt
from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmon.functions.dates import coerce_date, parse_wall_clock, parsed_once
from driftmon.functions.periods import check_split, parse_period, period_dates, period_key
from driftmon.functions.labels_index import index_labels, label_dictionary
from driftmon.functions.text import build_text, na_tokens_to_null
from driftmon.operators.joins import join_small

CELLS = ("title", "body", "label", "date")


def create_time_windows(df: DataFrame, split_type: str, range_size: int, date_col: str = "date",
                        on_bad_date: str = "drop") -> DataFrame:
    """Parse the wall-clock date and add ``split_type``, ``range`` and ``period``.

    ``on_bad_date="drop"`` removes rows whose date does not parse;
    ``"fail"`` raises if any row has such a date (one extra pass).
    """
    s = check_split(split_type, range_size)
    out = df.withColumn(date_col, parsed_once(parse_wall_clock(date_col)))
    if on_bad_date == "fail":
        bad = out.where(F.col(date_col).isNull()).limit(1).count()
        if bad:
            raise ValueError("unparseable date in input")
    elif on_bad_date != "drop":
        raise ValueError("on_bad_date must be 'drop' or 'fail'")
    first, last = period_dates(F.col(date_col), s, range_size)
    return (
        out.where(F.col(date_col).isNotNull())
        .withColumn("split_type", F.lit(s))
        .withColumn("range", F.lit(int(range_size)))
        .withColumn("period", period_key(F.col(date_col), s, range_size))
        .withColumn("period_start", first)
        .withColumn("period_end", last)
    )


def with_period_bounds(df: DataFrame, period_col: str = "period") -> DataFrame:
    """Add ``period_start`` / ``period_end`` dates parsed from the label."""
    p = parse_period(period_col)
    return df.withColumn("period_start", p.start).withColumn("period_end", p.end)


def target_window(split_type: str, start_year: int, end_year: int, start_month: int | None = None,
                  end_month: int | None = None, start_day: int | None = None,
                  end_day: int | None = None) -> tuple[dt.date, dt.date]:
    """A train range given as parts -> (first day, last day) at the split's precision."""
    s = check_split(split_type, 1)
    if s == "year":
        return dt.date(start_year, 1, 1), dt.date(end_year, 12, 31)
    if s == "month":
        return (dt.date(start_year, start_month, 1),
                dt.date(end_year, end_month, monthrange(end_year, end_month)[1]))
    return dt.date(start_year, start_month, start_day), dt.date(end_year, end_month, end_day)


def _where_bounds(df: DataFrame, period_col: str, cond) -> DataFrame:
    """Filter on the parsed (start, end) of the period, parsed once per row.

    On a partitioned window table ``period`` is a partition column, so the
    whole predicate is a partition filter and prunes folders before any read.
    """
    if "period_start" in df.columns and "period_end" in df.columns:
        return df.where(cond(F.col("period_start"), F.col("period_end")))
    tmp = df.withColumn("_period", parse_period(period_col))
    return tmp.where(cond(F.col("_period.start"), F.col("_period.end"))).drop("_period")


def train_windows(df: DataFrame, target: tuple[dt.date, dt.date], period_col: str = "period") -> DataFrame:
    """Windows overlapping the train range."""
    return _where_bounds(df, period_col, lambda ws, we: (ws <= F.lit(target[1])) & (we >= F.lit(target[0])))


def exact_window(df: DataFrame, target: tuple[dt.date, dt.date], period_col: str = "period") -> DataFrame:
    """The window equal to the target in start and end."""
    return _where_bounds(df, period_col, lambda ws, we: (ws == F.lit(target[0])) & (we == F.lit(target[1])))


def test_windows(df: DataFrame, target: tuple[dt.date, dt.date], split_type: str,
                 rule: str = "similarity", period_col: str = "period") -> DataFrame:
    """Windows after the train range.

    ``rule="similarity"``: start strictly after the range end (year, month, day).
    ``rule="evaluation"``: the classifier runs' rule, which for month windows
    also keeps the window starting in the range's last month.  For day windows
    it is strict too (the original selected nothing there).
    """
    return _where_bounds(df, period_col, _after(target, split_type, rule))


def _after(target: tuple[dt.date, dt.date], split_type: str, rule: str):
    s = check_split(split_type, 1)
    end = target[1]
    if rule not in ("similarity", "evaluation"):
        raise ValueError("rule must be 'similarity' or 'evaluation'")
    if rule == "evaluation" and s == "month":
        return lambda ws, we: ws >= F.lit(end.replace(day=1))
    return lambda ws, we: ws > F.lit(end)


def train_and_test_windows(df: DataFrame, target: tuple[dt.date, dt.date], split_type: str,
                           rule: str = "similarity", period_col: str = "period") -> DataFrame:
    """The rows of :func:`train_windows` and :func:`test_windows` in one frame, each once."""
    after = _after(target, split_type, rule)
    return _where_bounds(df, period_col, lambda ws, we: ((ws <= F.lit(target[1])) & (we >= F.lit(target[0]))) | after(ws, we))


def _by_key(df: DataFrame, ranges: DataFrame, keys, period_col: str, cond) -> DataFrame:
    if "period_start" in df.columns and "period_end" in df.columns:
        start, end, tmp = F.col("period_start"), F.col("period_end"), df
    else:
        tmp = df.withColumn("_period", parsed_once(parse_period(period_col)))
        start, end = F.col("_period.start"), F.col("_period.end")
    bounds = ranges.select(*keys, F.col("train_start").alias("_first"), F.col("train_end").alias("_last"))
    return join_small(tmp, bounds, list(keys)).where(cond(start, end, F.col("_first"), F.col("_last"))) \
        .drop("_period", "_first", "_last")


def train_windows_by_key(df: DataFrame, ranges: DataFrame, keys=("project",),
                         period_col: str = "period") -> DataFrame:
    """Train windows when every key has its own range (``train_start``, ``train_end``).

    ``ranges`` has one row per key; the join is an equi-join on the keys, its
    side broadcast only if small, with the overlap as condition.  Rows of keys
    without a range are left out.
    """
    return _by_key(df, ranges, keys, period_col, lambda ws, we, first, last: (ws <= last) & (we >= first))


def test_windows_by_key(df: DataFrame, ranges: DataFrame, split_type: str, keys=("project",),
                        rule: str = "similarity", period_col: str = "period") -> DataFrame:
    """Windows after the key's own train range, by the rules of :func:`test_windows`."""
    s = check_split(split_type, 1)
    if rule not in ("similarity", "evaluation"):
        raise ValueError("rule must be 'similarity' or 'evaluation'")
    if rule == "evaluation" and s == "month":
        return _by_key(df, ranges, keys, period_col, lambda ws, we, first, last: ws >= F.trunc(last, "month"))
    return _by_key(df, ranges, keys, period_col, lambda ws, we, first, last: ws > last)


def sort_periods(df: DataFrame, period_col: str = "period") -> DataFrame:
    """Chronological order of windows."""
    return df.orderBy(parse_period(period_col).start, F.col(period_col))


def filter_label_set(df: DataFrame, labels, label_col: str = "label") -> DataFrame:
    """Keep rows whose label is one of ``labels`` (no-op when ``labels`` is empty)."""
    return df.where(F.col(label_col).isin(list(labels))) if labels else df


def load_model_frame(windows: DataFrame, target: tuple[dt.date, dt.date], split_type: str,
                     test: bool = False, exact: bool = False, rule: str = "similarity",
                     labels=None, null_as_empty: bool = False, period_col: str = "period",
                     na_cells: bool = True, label_ids: bool = False, require_rows: bool = False) -> DataFrame:
    """Windows of a range as a model frame: missing cells null, ``text`` built, labels filtered.

    train (``test=False``): overlapping windows; ``test`` + ``exact``: the one
    window; ``test``: every window after the range by ``rule``.  ``na_cells``
    reads empty cells and the NA spellings of title, body, label and a date
    still in text as missing.  ``label_ids`` adds ``label_id``, the place of
    the label in the sorted ``labels`` (or the labels found).  With
    ``require_rows`` a range without rows is an error (one small extra job).
    """
    if not test:
        chosen = train_windows(windows, target, period_col)
    elif exact:
        chosen = exact_window(windows, target, period_col)
    else:
        chosen = test_windows(windows, target, split_type, rule, period_col)
    if na_cells:
        cells = [f.name for f in chosen.schema if f.name in CELLS and f.dataType.simpleString() == "string"]
        chosen = chosen.withColumns({c: na_tokens_to_null(c) for c in cells})
    if require_rows and chosen.limit(1).count() == 0:
        kind = "test" if test else "training"
        raise ValueError(f"no {kind} rows for {target[0]} to {target[1]} ({split_type} windows)")
    chosen = filter_label_set(chosen, labels)
    if dict(chosen.dtypes).get("date") == "string":
        chosen = chosen.withColumn("date", coerce_date("date"))
    if label_ids:
        known = chosen.where(F.col("label").isNotNull())
        chosen = index_labels(known, label_dictionary(known, "label", labels))
    return chosen.withColumn(
        "text", build_text("title", "body", null_as_empty)
    )
