"""DuckDB spellings of the column functions, used only by the oracle SQL.

Every function here mirrors one in ``driftmon.functions`` so that the oracle
and the Spark plan compute the same thing by independent routes.
"""

from __future__ import annotations

from driftmon.functions.text import UNPRINTABLE_RE2

# Written out here, apart from the library's own patterns: an oracle that shared them would share their faults.
_TIME = "([01][0-9]|2[0-3])"
_SIXTY = "[0-5][0-9]"
_ZONE = f"(Z|[+-]{_TIME}(:?{_SIXTY})?)?"
_EXTENDED = f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]{_TIME}(:{_SIXTY}(:{_SIXTY}([.,][0-9]+)?)?)?)?{_ZONE}$"
_COMPACT = f"^[0-9]{{8}}(T{_TIME}({_SIXTY}({_SIXTY}([.,][0-9]+)?)?)?{_ZONE})?$"
_OFFSET = "(Z|[+-][0-9]{2}:?[0-9]{2})$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_unprintable(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), {q(UNPRINTABLE_RE2)}, '', 'g')"


def iso_calendar_date(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, {q(_EXTENDED)}) THEN try_strptime(substr({x}, 1, 10), '%Y-%m-%d') "
        f"WHEN regexp_matches({x}, {q(_COMPACT)}) THEN try_strptime(substr({x}, 1, 8), '%Y%m%d') END)"
    )


def is_valid_date(x: str, min_year: int = 1900) -> str:
    return f"coalesce(year({iso_calendar_date(x)}) >= {min_year}, false)"


def wall_clock(x: str) -> str:
    return (
        f"try_strptime(regexp_replace(split_part({x}, '.', 1), {q(_OFFSET)}, ''), "
        f"'%Y-%m-%dT%H:%M:%S')"
    )


def utc_year(x: str) -> str:
    return f"CAST(year(timezone('UTC', try_strptime({x}, '%Y-%m-%dT%H:%M:%S.%f%z'))) AS INTEGER)"


def pmod(a: str, n: int) -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def period_key(ts: str, split_type: str, n: int) -> str:
    if split_type == "year":
        base = f"year({ts})"
    elif split_type == "month":
        base = f"(year({ts}) * 12 + month({ts}) - 1)"
    else:
        base = f"date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE))"
    s = f"({base} - {pmod(base, n)})"
    e = f"({s} + {n - 1})"
    if split_type == "year":
        return f"printf('%d_%d', {s}, {e})"
    if split_type == "month":
        return (f"printf('%d-%02d_%d-%02d', {s} // 12, {pmod(s, 12)} + 1, "
                f"{e} // 12, {pmod(e, 12)} + 1)")
    return (f"strftime(DATE '1970-01-01' + CAST({s} AS INTEGER), '%Y-%m-%d') || '_' || "
            f"strftime(DATE '1970-01-01' + CAST({e} AS INTEGER), '%Y-%m-%d')")


def map_label(x: str) -> str:
    from driftmon.functions.labels import map_label_sql

    return map_label_sql(x)


CLEAN_ISSUES = f"""
SELECT DISTINCT project, replace(title, chr(0), '') AS title, replace(body, chr(0), '') AS body,
       replace(label, chr(0), '') AS label, replace(date, chr(0), '') AS date
FROM issues WHERE {is_valid_date("replace(date, chr(0), '')")}
"""

MAPPED_ISSUES = f"""
SELECT project, title, body, {map_label("label")} AS label, date
FROM ({CLEAN_ISSUES}) c WHERE {map_label("label")} IS NOT NULL
"""


def windowed_issues(split_type: str, n: int) -> str:
    ts = wall_clock("date")
    return f"""
SELECT project, title, body, label, {ts} AS date, {period_key(ts, split_type, n)} AS period
FROM ({MAPPED_ISSUES}) m WHERE {ts} IS NOT NULL
"""


YEAR_RE = r"^(\d+)_(\d+)$"
MONTH_RE = r"^(\d+)-(\d{1,2})_(\d+)-(\d{1,2})$"
DAY_RE = r"^(\d+)-(\d{1,2})-(\d{1,2})_(\d+)-(\d{1,2})-(\d{1,2})$"


def _g(x: str, pattern: str, i: int) -> str:
    return f"TRY_CAST(regexp_extract({x}, {q(pattern)}, {i}) AS INTEGER)"


def split_type_of(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q(YEAR_RE)}) THEN 'year' "
            f"WHEN regexp_matches({x}, {q(MONTH_RE)}) THEN 'month' "
            f"WHEN regexp_matches({x}, {q(DAY_RE)}) THEN 'day' END)")


def period_start(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q(YEAR_RE)}) THEN make_date({_g(x, YEAR_RE, 1)}, 1, 1) "
            f"WHEN regexp_matches({x}, {q(MONTH_RE)}) THEN make_date({_g(x, MONTH_RE, 1)}, {_g(x, MONTH_RE, 2)}, 1) "
            f"WHEN regexp_matches({x}, {q(DAY_RE)}) THEN make_date({_g(x, DAY_RE, 1)}, {_g(x, DAY_RE, 2)}, {_g(x, DAY_RE, 3)}) END)")


def period_end(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q(YEAR_RE)}) THEN make_date({_g(x, YEAR_RE, 2)}, 12, 31) "
            f"WHEN regexp_matches({x}, {q(MONTH_RE)}) THEN last_day(make_date({_g(x, MONTH_RE, 3)}, {_g(x, MONTH_RE, 4)}, 1)) "
            f"WHEN regexp_matches({x}, {q(DAY_RE)}) THEN make_date({_g(x, DAY_RE, 4)}, {_g(x, DAY_RE, 5)}, {_g(x, DAY_RE, 6)}) END)")


def windowed_by_month() -> str:
    return windowed_issues("month", 1)


WHITESPACE_RE2 = r"^[\t\n\x0B\f\r\x{85}\p{Z}]+|[\t\n\x0B\f\r\x{85}\p{Z}]+$"


def normalise_text(x: str) -> str:
    return f"coalesce(regexp_replace({x}, {q(WHITESPACE_RE2)}, '', 'g'), '')"
