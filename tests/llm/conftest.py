from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, n int, level string, place int"


def make_docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, "x", 1, "y", 2) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


LONG = " ".join(f"word{i % 977}" for i in range(40_000))

MESSY = [
    (1, "Alpha beta gamma delta epsilon zeta", "a"),
    (2, "Alpha  beta\tgamma delta\nepsilon zeta", "a"),
    (3, None, "a"),
    (4, "", "b"),
    (5, " \t\n\x0b\x0c\r", "b"),
    (6, LONG, "b"),
    (7, LONG + " tail", "c"),
    (8, "Alpha beta gamma delta epsilon zeta", None),
    (8, "Alpha beta gamma delta epsilon zeta", None),
    (None, "no id here at all", "c"),
    (None, None, None),
    (10, "é", "c"),
    (11, "no id here at all", "d"),
]


@pytest.fixture(scope="session")
def messy(spark):
    return make_docs(spark, MESSY)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
