"""Column functions for text fields (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings pandas' CSV reader turns into a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Characters Python's str.isprintable() rejects: every "other" (control, format,
# surrogate, private use, unassigned) and every separator except the ASCII space.
UNPRINTABLE_JAVA = r"[\p{C}\p{Z}&&[^ ]]"
# The same class for RE2 (DuckDB), which has no class intersection.
UNPRINTABLE_RE2 = r"[\p{C}\p{Zl}\p{Zp}]|[^\P{Zs} ]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_unprintable(col, replace_with: str = "") -> Column:
    """Null -> ''; drop unprintable characters (newlines and tabs too, so words join)."""
    return F.regexp_replace(F.coalesce(_c(col).cast("string"), F.lit("")), UNPRINTABLE_JAVA, replace_with)


def strip_nul(col) -> Column:
    """Remove NUL bytes (the cleaner does this before parsing its CSV)."""
    return F.replace(_c(col), F.lit("\u0000"), F.lit(""))


def na_tokens_to_null(col, tokens=NA_TOKENS) -> Column:
    """What a pandas CSV read does to a string cell: NA spellings become null."""
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def build_text(title, body, null_as_empty: bool = False) -> Column:
    """``title + " " + body``; null if either is null, then ''.

    With ``null_as_empty`` a missing part counts as '' instead of emptying the text.
    """
    t, b = _c(title), _c(body)
    if null_as_empty:
        t, b = F.coalesce(t, F.lit("")), F.coalesce(b, F.lit(""))
    return F.coalesce(F.concat(t, F.lit(" "), b), F.lit(""))


def normalise_text(col) -> Column:
    """Null -> '', else the string with leading/trailing whitespace removed."""
    return F.coalesce(F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", ""), F.lit(""))


def row_text_fallback(title, body) -> Column:
    """Text made from trimmed title and trimmed body when no text column exists."""
    joined = F.concat(normalise_text(title), F.lit(" "), normalise_text(body))
    return F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")


def is_empty_text(col) -> Column:
    return normalise_text(col) == ""
