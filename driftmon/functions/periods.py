"""Calendar windows: period keys, their inverse, and their display forms.

A period key buckets a timestamp into ``n`` years, months or days counted from
zero (year 0, month 0 = January of year 0, day 0 = 1970-01-01).  Labels:

* year  ``2000_2001``
* month ``2000-01_2000-03``
* day   ``2000-01-01_2000-01-07``

Everything is integer arithmetic on columns (``pmod`` floors like Python's
``%``, also before 1970), so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_TYPES = ("year", "month", "day")
EPOCH = "1970-01-01"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def check_split(split_type: str, n: int) -> str:
    s = split_type.lower()
    if s not in SPLIT_TYPES:
        raise ValueError(f"no split called {split_type!r}; known: {', '.join(SPLIT_TYPES)}")
    if int(n) < 1:
        raise ValueError("range must be a positive integer")
    return s


def _floor_start(base: Column, n: int) -> Column:
    return base - F.pmod(base, F.lit(n))


def period_bounds(ts, split_type: str, n: int) -> tuple[Column, Column]:
    """(start, end) unit numbers of the window holding ``ts``."""
    s = check_split(split_type, n)
    t = _c(ts)
    if s == "year":
        base = F.year(t)
    elif s == "month":
        base = F.year(t) * 12 + F.month(t) - 1
    else:
        base = F.datediff(F.to_date(t), F.lit(EPOCH))
    start = _floor_start(base, n)
    return start, start + (n - 1)


def _month_label(unit: Column) -> Column:
    year = F.floor(unit / 12).cast("int")
    return F.format_string("%d-%02d", year, (F.pmod(unit, F.lit(12)) + 1).cast("int"))


def period_key(ts, split_type: str, n: int) -> Column:
    """Window label of a timestamp (``Y_Y``, ``Y-MM_Y-MM`` or ``Y-MM-DD_Y-MM-DD``)."""
    s = check_split(split_type, n)
    start, end = period_bounds(ts, s, n)
    if s == "year":
        return F.format_string("%d_%d", start, end)
    if s == "month":
        return F.concat(_month_label(start), F.lit("_"), _month_label(end))
    epoch = F.to_date(F.lit(EPOCH))
    return F.concat(
        F.date_format(F.date_add(epoch, start), "yyyy-MM-dd"),
        F.lit("_"),
        F.date_format(F.date_add(epoch, end), "yyyy-MM-dd"),
    )


def period_dates(ts, split_type: str, n: int) -> tuple[Column, Column]:
    """(first day, last day) of the window holding ``ts``, from the unit numbers."""
    s = check_split(split_type, n)
    start, end = period_bounds(ts, s, n)
    if s == "year":
        return F.make_date(start, F.lit(1), F.lit(1)), F.make_date(end, F.lit(12), F.lit(31))
    if s == "month":
        def first(u):
            return F.make_date(F.floor(u / 12).cast("int"), (F.pmod(u, F.lit(12)) + 1).cast("int"), F.lit(1))
        return first(start), F.last_day(first(end))
    epoch = F.to_date(F.lit(EPOCH))
    return F.date_add(epoch, start), F.date_add(epoch, end)


_YEAR_RE = r"^(\d+)_(\d+)$"
_MONTH_RE = r"^(\d+)-(\d{1,2})_(\d+)-(\d{1,2})$"
_DAY_RE = r"^(\d+)-(\d{1,2})-(\d{1,2})_(\d+)-(\d{1,2})-(\d{1,2})$"


def strip_extension(col) -> Column:
    return F.regexp_replace(_c(col), r"\.csv$", "")


def _grp(label: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(label, pattern, i).try_cast("int")


def split_type_of(label) -> Column:
    """'year', 'month' or 'day' from the shape of a window label; null if none."""
    lab = strip_extension(label)
    return (
        F.when(lab.rlike(_YEAR_RE), "year")
        .when(lab.rlike(_MONTH_RE), "month")
        .when(lab.rlike(_DAY_RE), "day")
    )


def _date(y: Column, m: Column, d: Column) -> Column:
    """Date from parts without a string round trip; null if the parts are impossible."""
    return F.to_date(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)))


_ANY_RE = r"^\d+(-\d{1,2}(-\d{1,2})?)?_\d+(-\d{1,2}(-\d{1,2})?)?$"


def parse_period(label) -> Column:
    """Window label -> struct(split_type, start DATE, end DATE); null if unrecognised.

    ``end`` is the last day of the last unit, so windows compare as date ranges.
    One regex check, then plain splits (cheap per row).
    """
    lab = strip_extension(label)
    halves = F.split(lab, "_")
    a = F.split(F.get(halves, 0), "-")
    b = F.split(F.get(halves, 1), "-")
    n = F.size(a)
    ok = lab.rlike(_ANY_RE) & (n == F.size(b))

    def part(arr, i):
        return F.get(arr, i).try_cast("int")

    kind = F.when(ok, F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("day")), n))
    start = F.when(ok, _date(part(a, 0), F.coalesce(part(a, 1), F.lit(1)), F.coalesce(part(a, 2), F.lit(1))))
    end_first = _date(part(b, 0), F.coalesce(part(b, 1), F.lit(12)), F.coalesce(part(b, 2), F.lit(1)))
    end = F.when(ok, F.when(n == 3, end_first).otherwise(F.last_day(end_first)))
    return F.struct(kind.alias("split_type"), start.alias("start"), end.alias("end"))


def with_parsed_period(df, period_col: str = "period", out: str = "_period"):
    """Add the parsed period once as a struct column (referenced many times later)."""
    return df.withColumn(out, parse_period(period_col))


def format_period(label) -> Column:
    """Printable range: ``2000-2001``, ``2000-01 to 2000-03``, ``2000-01-01 to 2000-01-07``."""
    p = parse_period(label)
    return (
        F.when(p.split_type == "year", F.format_string("%d-%d", F.year(p.start), F.year(p.end)))
        .when(p.split_type == "month", F.concat(F.date_format(p.start, "yyyy-MM"), F.lit(" to "), F.date_format(p.end, "yyyy-MM")))
        .when(p.split_type == "day", F.concat(F.date_format(p.start, "yyyy-MM-dd"), F.lit(" to "), F.date_format(p.end, "yyyy-MM-dd")))
    )


def period_short(label) -> Column:
    """Per-window label of the similarity table: start year, ``Y-MM`` or ``Y-MM-DD``."""
    p = parse_period(label)
    return (
        F.when(p.split_type == "year", F.year(p.start).cast("string"))
        .when(p.split_type == "month", F.date_format(p.start, "yyyy-MM"))
        .when(p.split_type == "day", F.date_format(p.start, "yyyy-MM-dd"))
    )


def align_period(label, range_size: int) -> Column:
    """Report label -> similarity label: drop the extension; range 1 keeps the part after '_'."""
    lab = strip_extension(label)
    if int(range_size) == 1:
        return F.split_part(lab, F.lit("_"), F.lit(2))
    return lab


def period_year(period) -> Column:
    """First four consecutive digits of a period label as an int."""
    return F.regexp_extract(_c(period), r"(\d{4})", 1).try_cast("int")


# Window label shapes the performance timeline understands.  The first four
# are the historical report-file spellings; the last two are what the window
# builder writes for year and day windows.  Two numbers are a year range,
# four a month range, six a day range.
INFO_PATTERNS = [
    r"^(\d{4})-(\d{4})$",
    r"^(\d{4})-(\d{1,2})_(\d{4})-(\d{1,2})$",
    r"^(\d{4})_(\d{2})-(\d{4})_(\d{2})$",
    r"^(\d{4})_(\d{2})_(\d{2})-(\d{4})_(\d{2})_(\d{2})$",
    r"^(\d{4})_(\d{4})$",
    r"^(\d{4})-(\d{2})-(\d{2})_(\d{4})-(\d{2})-(\d{2})$",
]
INFO_FIELDS = ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day")


def extract_date_info(label) -> Column:
    """Window label -> struct of six date parts (end_day may be null); null if no shape matches."""
    lab = strip_extension(label)
    shape = "|".join(f"(?:{p})" for p in INFO_PATTERNS)
    nums = F.transform(F.regexp_extract_all(lab, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    n = F.size(nums)

    def at(i):
        return F.get(nums, i)

    one, twelve = F.lit(1), F.lit(12)
    by_size = {
        2: (at(0), one, one, at(1), twelve, F.lit(31)),
        4: (at(0), at(1), one, at(2), at(3), F.lit(None).cast("int")),
        6: (at(0), at(1), at(2), at(3), at(4), at(5)),
    }
    fields = []
    for k, name in enumerate(INFO_FIELDS):
        v = F.when(n == 2, by_size[2][k]).when(n == 4, by_size[4][k]).when(n == 6, by_size[6][k])
        fields.append(v.cast("int").alias(name))
    return F.when(lab.rlike(shape), F.struct(*fields))


def _ts(y, m, d) -> Column:
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))


def decimal_year(info) -> Column:
    """Plot position of a window as a decimal year.

    Same month -> ``y + (m-1)/12``; a full single year -> ``y``; otherwise the
    midpoint of start and end as a fraction of its year.  A missing end day is
    30/31 by month (28 for February, leap years ignored); an impossible date
    falls back to the start month.
    """
    i = _c(info)
    sy, sm, sd = i.start_year, i.start_month, F.coalesce(i.start_day, F.lit(1))
    ey, em = i.end_year, i.end_month
    ed = F.coalesce(
        i.end_day,
        F.when(em == 2, 28).when(em.isin(4, 6, 9, 11), 30).otherwise(31),
    )
    month_point = sy + (sm - 1) / F.lit(12.0)
    start, end = _ts(sy, sm, sd), _ts(ey, em, ed)
    mid = (F.unix_seconds(start) + F.unix_seconds(end)) / 2.0
    mid_year = F.year(F.timestamp_seconds(mid))
    y0 = F.unix_seconds(_ts(mid_year, F.lit(1), F.lit(1)))
    y1 = F.unix_seconds(_ts(mid_year + 1, F.lit(1), F.lit(1)))
    midpoint = mid_year + (mid - y0) / (y1 - y0)
    return (
        F.when(i.isNull(), F.lit(None).cast("double"))
        .when((sy == ey) & (sm == em), month_point)
        .when((sy == ey) & (sm == 1) & (em == 12), sy.cast("double"))
        .when(start.isNull() | end.isNull(), month_point)
        .otherwise(midpoint)
    )


def display_month(decimal) -> Column:
    """Decimal year -> ``Y-MM`` (whole years show January)."""
    d = _c(decimal)
    year = F.floor(d).cast("int")
    month = F.when(d == F.floor(d), 1).otherwise(F.floor((d - F.floor(d)) * 12).cast("int") + 1)
    return F.format_string("%d-%02d", year, month)
