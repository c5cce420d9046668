"""Date parsing for issue timestamps such as ``2021-12-14T16:45:26.000+0000``.

Two readings of the same string exist and both are kept on purpose:

* ``parse_wall_clock``: the local wall-clock time, offset ignored (windows);
* ``parse_utc``: the instant converted to UTC (overall distribution table).

A 31 December evening at -0500 therefore lands in different years in the two.
All parsers return null for a bad string (ANSI mode would raise otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK_FORMAT = "yyyyMMddHHmmss"
# ISO 8601 forms of issue dates: a date, optionally a time (minutes, seconds,
# a fraction of any length after a point or comma), optionally Z or an offset;
# the same in the compact basic form.
ISO_DATETIME_RE = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?$"
)
ISO_BASIC_RE = (
    r"^\d{8}(?:T(?:[01]\d|2[0-3])(?:[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?$"
)
# Year, month, day, hour, minute, second, fraction, sign, offset hours and minutes of either form.
PARTS_RE = (
    r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})?:?(\d{2})?(?:[.,](\d+))?)?"
    r"(?:Z|([+-])(\d{2}):?(\d{2})?)?$"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _is_iso(c: Column) -> Column:
    return c.rlike(f"{ISO_DATETIME_RE}|{ISO_BASIC_RE}")


def _clock_digits(c: Column) -> Column:
    """``yyyyMMddHHmmss`` as written, without fraction and offset; null when not ISO."""
    digits = F.regexp_replace(c, PARTS_RE, "$1$2$3$4$5$6")  # parts that are not written add nothing
    return F.when(_is_iso(c), F.rpad(digits, 14, "0"))


def parse_wall_clock(col) -> Column:
    """The local wall clock of every form ``is_valid_date`` accepts; the offset and fraction are dropped."""
    return F.try_to_timestamp(_clock_digits(_c(col)), F.lit(CLOCK_FORMAT))


def parse_utc(col) -> Column:
    """The instant of every form ``is_valid_date`` accepts; no offset means UTC."""
    c = _c(col)
    at = F.try_to_timestamp(F.concat(_clock_digits(c), F.lit("+0000")), F.lit(CLOCK_FORMAT + "xx"))
    micros = F.rpad(F.substring(F.regexp_replace(c, PARTS_RE, "$7"), 1, 6), 6, "0").try_cast("long")
    # [+-]hhmm; zeros where no offset is written
    offset = F.rpad(F.regexp_replace(c, PARTS_RE, "$8$9$10"), 5, "0")
    minutes = F.substring(offset, 2, 2).try_cast("long") * 60 + F.substring(offset, 4, 2).try_cast("long")
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    return F.timestamp_micros(F.unix_micros(at) + micros - sign * minutes * 60_000_000)


def parsed_once(parsed: Column) -> Column:
    """``parsed`` behind a step that the optimiser does not inline.

    Filters and columns derived from it read the finished value; without the
    step each of them would parse the string again.
    """
    return F.explode(F.array(parsed))


def iso_calendar_date(col) -> Column:
    """The calendar date written in an ISO string (its own offset), or null."""
    c = _c(col)
    extended = F.when(c.rlike(ISO_DATETIME_RE), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    basic = F.when(c.rlike(ISO_BASIC_RE), F.try_to_date(F.substring(c, 1, 8), "yyyyMMdd"))
    return F.coalesce(extended, basic)


def is_valid_date(col, min_year: int = 1900) -> Column:
    """True when the string is an ISO date(-time) whose own year is >= ``min_year``."""
    d = iso_calendar_date(col)
    return F.coalesce(d.isNotNull() & (F.year(d) >= F.lit(min_year)), F.lit(False))


def coerce_date(col) -> Column:
    """Bad values become null instead of failing the job."""
    c = _c(col)
    return F.coalesce(F.try_to_timestamp(c.cast("string")), parse_wall_clock(c.cast("string")))
