"""Export, clean, de-duplicate and label-map issue rows (one lazy plan).

The reference streams CSV files row by row; here the same steps are column
expressions on one DataFrame, and de-duplication is a hash aggregate with
map-side partial aggregation (identical copies collapse before the shuffle,
so a key holding many copies does not overload one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.functions.dates import is_valid_date
from driftmon.functions.labels import LABEL_PATTERNS, map_label
from driftmon.functions.text import strip_nul, strip_unprintable

# The four source fields and the names they get.
INPUT_FIELDS = {
    "title": "fields.summary",
    "body": "fields.description",
    "label": "fields.issuetype.name",
    "date": "fields.created",
}
OUTPUT_FIELDS = ["title", "body", "label", "date"]


def flatten_fields(docs: DataFrame, keys=("project",), fields=INPUT_FIELDS,
                   printable_only: bool = True, replace_with: str = "") -> DataFrame:
    """Nested document -> flat row; a missing or null path gives ''.

    With ``printable_only`` every unprintable character is removed, as the
    exporter does (newlines and tabs vanish, adjoining words join).
    """
    cols = [F.col(k) for k in keys]
    for out, path in fields.items():
        value = F.coalesce(F.col(path).cast("string"), F.lit(""))
        if printable_only:
            value = strip_unprintable(value, replace_with)
        cols.append(value.alias(out))
    return docs.select(*cols)


def rename_issue_columns(df: DataFrame, keys=("project",), mapping=None) -> DataFrame:
    """Exported dotted column names -> title, body, label, date."""
    mapping = mapping or {v: k for k, v in INPUT_FIELDS.items()}
    return df.select(*keys, *[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])


def filter_valid_dates(df: DataFrame, date_col: str = "date", min_year: int = 1900,
                       enabled: bool = True) -> DataFrame:
    """Keep rows whose ISO date parses and whose own year is >= ``min_year``."""
    return df.where(is_valid_date(date_col, min_year)) if enabled else df


def dedup_issues(df: DataFrame, keys=("project",), columns=tuple(OUTPUT_FIELDS),
                 enabled: bool = True) -> DataFrame:
    """Drop rows identical in the content columns (per key)."""
    return df.dropDuplicates([*keys, *columns]) if enabled else df


def clean_issues(df: DataFrame, keys=("project",), remove_invalid_dates: bool = True,
                 remove_duplicates: bool = True) -> DataFrame:
    """NUL bytes out, invalid dates out, exact duplicates out."""
    cleaned = df.select(*keys, *[strip_nul(c).alias(c) for c in OUTPUT_FIELDS])
    cleaned = filter_valid_dates(cleaned, enabled=remove_invalid_dates)
    return dedup_issues(cleaned, keys, enabled=remove_duplicates)


def map_labels(df: DataFrame, label_col: str = "label", patterns=LABEL_PATTERNS,
               keep_unmapped: bool = False) -> DataFrame:
    """Replace the label by its class; rows no pattern matches are dropped."""
    mapped = df.withColumn(label_col, F.coalesce(map_label(label_col, patterns),
                                                 F.col(label_col) if keep_unmapped else F.lit(None)))
    return mapped if keep_unmapped else mapped.where(F.col(label_col).isNotNull())


def drop_unmapped(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col).isNotNull())
