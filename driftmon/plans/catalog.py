"""Registry of the named queries the driver runs, each with its DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``.  The oracle is SQL text over
the driver's tables (the fixture views are prepended as CTEs), or ``None``
when the operator has no SQL form (statistical kernels, fitted models); those
are checked by row count here and by unit tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (or none)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from driftmon.plans import (  # noqa: F401
        q_prepare,
        q_windows,
        q_reports,
        q_sampling,
        q_similarity,
        q_series,
        q_models,
        q_jobs,
        q_round_trips,
    )
