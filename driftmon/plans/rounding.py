"""Output shaping shared by the registered queries (not by the operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column; NaN becomes null (both engines then agree)."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float"):
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(F.round(c.cast("double"), digits))
        cols.append(c.alias(name))
    return df.select(*cols)


def r(x: str, digits: int = DIGITS) -> str:
    """The SQL side of ``rounded`` for one expression."""
    return f"round(CAST(nullif({x}, 'NaN'::DOUBLE) AS DOUBLE), {digits})"
