"""CSV read by byte ranges against Python's csv module."""

from __future__ import annotations

import csv
import random

import pytest

from driftmon.sources import csv_ranges as C
from driftmon.sources.issues_io import ISSUE_CSV_SCHEMA, read_issues_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so records cross borders."""
    names = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def make_rows(seed, n):
    rng = random.Random(seed)
    pieces = ['say "hi"', "a,b", "line\nbreak", "\n\n", '""', "é ü", " ", "plain", "x" * 50, "tab\t", '"']
    rows = [["".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(4)] for _ in range(n)]
    rows[n // 2][1] = ("a long body, \n" + '"quoted" \n') * 150  # runs through several whole ranges
    return rows


def write(path, rows, ends="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator=ends)
        w.writerow(["title", "body", "label", "date"])
        w.writerows(rows)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_across_range_borders(spark, tmp_path, small_ranges, ends):
    rows = [make_rows(1, 120), make_rows(2, 37)]
    for k, own in enumerate(rows):
        write(tmp_path / f"part-{k}.csv", own, ends)
    lines = C._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    states = C.range_states(lines).collect()
    assert len(states) > 20 and {r.inside for r in states} == {True, False}
    back = read_issues_csv(spark, str(tmp_path))
    assert back.columns == [f.name for f in ISSUE_CSV_SCHEMA.fields]
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for own in rows for r in own)


def test_long_header_and_unquoted_fields(spark, tmp_path, small_ranges):
    with open(tmp_path / "a.csv", "w") as f:
        f.write('title,"bo' + "\n" * 900 + 'dy",label,date\n\n1,,"",x\n2,b c,L,\n\n')
    got = sorted(map(tuple, read_issues_csv(spark, str(tmp_path)).collect()))
    assert got == [("1", None, "", "x"), ("2", "b c", "L", None)]


def test_empty_files_and_no_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("title,body,label,date\n")
    assert read_issues_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "n.txt").write_text('"a ""x""\n,b"\nc')
    assert sorted(r.text for r in C.csv_records(spark, str(tmp_path / "n.txt"), header=False).collect()) == ['"a ""x""\n,b"', "c"]
