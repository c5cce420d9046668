"""Label mapping: free-form issue types -> a small set of classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms per class, tried in this order; a label maps to the
# first class whose pattern matches at the start of the label, ignoring case.
BUG_SYNONYMS = ["bug", "report"]
FEATURE_SYNONYMS = ["new feature", "improvement", "suggestion", "feature request", "enhancement"]
QUESTION_SYNONYMS = ["support request", "question"]

LABEL_PATTERNS = [
    ("(" + "|".join(BUG_SYNONYMS) + ")", "bug"),
    ("(" + "|".join(FEATURE_SYNONYMS) + ")", "feature"),
    ("(" + "|".join(QUESTION_SYNONYMS) + ")", "question"),
]


def map_label(col, patterns=LABEL_PATTERNS) -> Column:
    """First pattern matching at the start of the label (case-insensitive) wins; else null."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for pattern, target in patterns:
        cond = c.rlike(f"(?i)^{pattern}")
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out


def map_label_sql(col: str, patterns=LABEL_PATTERNS) -> str:
    """The same mapping as a DuckDB/ANSI CASE expression (used by oracles)."""
    arms = " ".join(
        f"WHEN regexp_matches({col}, '(?i)^{p}') THEN '{t}'" for p, t in patterns
    )
    return f"CASE {arms} END"
