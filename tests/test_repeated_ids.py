"""Samples of groups in which one id holds most rows, and places from one range sort."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmon.operators import sampling as S
from driftmon.operators.quantiles import rank_rows


@pytest.mark.parametrize("parts", [1, 9])
def test_one_id_in_most_rows_of_a_class(spark, parts):
    rows = [(7, f"copy {i}", "a") for i in range(3000)] + [(i, f"own {i}", "a") for i in range(100, 400)]
    rows += [(i, f"b {i}", "b") for i in range(50)] + [(None, f"c {i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(parts)
    out = S.sample_per_class(df, "label", "id", n=40, seed=3).collect()
    got = {label: sorted((r.id is None, r.id, r.text) for r in out if r.label == label) for label in ("a", "b", None)}
    assert [len(v) for v in got.values()] == [40, 40, 20]

    # without keys, all rows have one constant key beside their columns
    content = {(r.id, r.text): r.h for r in df.withColumn("h", F.xxhash64("id", "text", "label", F.lit(0))).collect()}
    order = lambda r: (hashlib.md5(f"{r[0]}:3".encode()).hexdigest(), r[0], content[(r[0], r[1])])
    for label in ("a", "b"):
        want = sorted((r for r in rows if r[2] == label), key=order)[:40]
        assert got[label] == sorted((False, r[0], r[1]) for r in want)


def test_a_large_quota_among_copies_of_an_id(spark):
    rows = [(1, f"{i:05}", "a") for i in range(2000)] + [(2, f"{i:05}", "a") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(6)
    split = S.train_validation_split(df, "label", "id", split_size=0.5)
    counts = {(r.id, r.split): r["count"] for r in split.groupBy("id", "split").count().collect()}
    first = min((1, 2), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    own = {1: 2000, 2: 1000}
    assert counts.get((first, "validation"), 0) == min(own[first], 1500)
    assert sum(n for (_, s), n in counts.items() if s == "validation") == 1500


def test_places_equal_a_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(str(k) if k else None, int(v)) for k, v in zip(rng.integers(0, 4, 900), rng.integers(0, 50, 900))]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = sorted((str(r.k), r.place, r.v) for r in rank_rows(df, ["k"], ["v"], "place").collect())
    want = []
    for k in {r[0] for r in rows}:
        want += [(str(k), i + 1, v) for i, v in enumerate(sorted(v for g, v in rows if g == k))]
    assert got == sorted(want)
    assert rank_rows(df.limit(0), ["k"], ["v"], "place").count() == 0
    plan = rank_rows(df, ["k"], ["v"], "place")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "SinglePartition" not in plan  # windows run over the counts by partition alone
