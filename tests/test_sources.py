"""Sources, sinks and jobs on small written files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from driftmon.operators import cleaning
from driftmon.plans import jobs
from driftmon.sources import issues_io


def test_nested_documents_missing_fields_become_empty(spark, tmp_path):
    docs = [
        {"project": "A", "fields": {"summary": "s1", "description": "line1\nline2\tend",
                                    "issuetype": {"name": "Bug"}, "created": "2001-02-03T04:05:06.000+0000"}},
        {"project": "A", "fields": {"summary": "s2", "issuetype": None, "created": "2001-02-03T04:05:06.000+0000"}},
        {"project": "A"},
        {"project": "B", "fields": {"summary": None, "description": "d", "issuetype": {}, "created": None}},
    ]
    path = tmp_path / "docs.jsonl"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    flat = cleaning.flatten_fields(issues_io.read_issue_documents(spark, str(path)))
    rows = flat.orderBy("project", "title").collect()
    assert [r.asDict() for r in rows][0]["title"] == ""  # the whole 'fields' missing -> ''
    by_title = {r.title: r for r in rows}
    assert by_title["s1"].body == "line1line2end" and by_title["s1"].label == "Bug"
    assert by_title["s2"].label == "" and by_title["s2"].body == ""
    assert sorted(r.project for r in rows) == ["A", "A", "A", "B"]


def test_csv_round_trip_keeps_quotes_newlines_and_spaces(spark, tmp_path):
    rows = [(' lead', 'say "hi"\nnext line', 'Bug', '2001-01-01T00:00:00.000+0000'),
            ('trail ', 'a,b', 'New Feature', '2002-01-01T00:00:00.000+0000')]
    df = spark.createDataFrame(rows, issues_io.ISSUE_CSV_SCHEMA)
    path = str(tmp_path / "issues")
    issues_io.write_issues_csv(df.coalesce(1), path)
    back = issues_io.read_issues_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_prepare_issues_rejects_unknown_step(spark):
    df = spark.createDataFrame([("P", "t", "b", "Bug", "2001-01-01")], "project string, title string, body string, label string, date string")
    with pytest.raises(ValueError):
        jobs.prepare_issues(df, steps=["clean", "shuffle"])
    out = jobs.prepare_issues(df, steps=["clean", "map"]).collect()
    assert out[0].label == "bug"


def test_select_collections_raise_and_warn(spark):
    from driftmon.operators.collections import select_collections

    df = spark.createDataFrame([("A", 1), ("B", 2)], "project string, n int")
    with pytest.raises(ValueError, match="Z"):
        select_collections(df, ["A", "Z"], on_missing="raise")
    kept, missing = select_collections(df, ["A", "Z"], on_missing="warn")
    assert [r.project for r in kept.collect()] == ["A"] and missing == ["Z"]


def test_stream_distribution_counts(spark, tmp_path):
    from driftmon.streaming.distribution_stream import (
        read_issue_stream, start_distribution_query, window_distribution_stream)

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"project": "P", "title": "t", "body": "b", "label": lab, "date": d}
            for lab, d in [("Bug", "2001-05-01T00:00:00.000+0000"), ("Question", "2001-06-01T00:00:00.000+0000"),
                           ("Sub-task", "2001-06-01T00:00:00.000+0000"), ("Bug", "2002-01-01T00:00:00.000+0000")]]
    (src / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    q = start_distribution_query(window_distribution_stream(read_issue_stream(spark, str(src))),
                                 str(tmp_path / "ckpt"), query_name="dist_test", trigger_once=True)
    q.awaitTermination()
    got = {(r.period, r.bug, r.question) for r in spark.table("dist_test").collect()}
    assert got == {("2001_2001", 1, 1), ("2002_2002", 1, 0)}


def test_window_distribution_totals(spark):
    from driftmon.operators.distribution import window_distribution

    df = spark.createDataFrame([("P", "w1", "bug"), ("P", "w1", "Feature"), ("P", "w2", "bug")],
                               "project string, period string, label string")
    got = {r.period: (r.bug, r.feature, r.is_total) for r in window_distribution(df).collect()}
    assert got == {"w1": (1, 1, False), "w2": (1, 0, False), "Total": (2, 1, True)}
    assert F is not None
