"""Run tables, missing cells and empty ranges of the model frame, similarity from text."""

import datetime as dt

import numpy as np
import pytest

from driftmon.operators import model as M
from driftmon.operators import sampling as S
from driftmon.operators import windows as W
from driftmon.plans import jobs
from driftmon.sources.issues_io import read_runs, write_run

RUN = {"model_type": "logistic", "split_type": "month", "range": 1, "train_start": dt.date(2020, 1, 1), "train_end": "2020-12-31"}


def test_a_run_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "project string, score double")
    with pytest.raises(FileNotFoundError):
        read_runs(spark, path)
    write_run(first, path, RUN)
    write_run(first, path, {**RUN, "range": "007"})
    write_run(first.where("project = 'a'"), path, RUN)
    write_run(first.where("project = 'a'"), path, RUN)
    got = sorted((r.range, r.project, r.train_start) for r in read_runs(spark, path).collect())
    assert got == [("007", "a", "2020-01-01"), ("007", "b", "2020-01-01"), ("1", "a", "2020-01-01")]
    write_run(first.limit(0), path, RUN)
    assert read_runs(spark, path, range=1).count() == 0 and read_runs(spark, path, range="007").count() == 2
    plan = read_runs(spark, path, range="007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan
    for bad in ({**RUN, "model_type": "a/b"}, {**RUN, "model_type": ""}, {k: v for k, v in RUN.items() if k != "range"}, {**RUN, "who": 1}):
        with pytest.raises(ValueError):
            write_run(first, path, bad)
    with pytest.raises(ValueError):
        write_run(first.withColumnRenamed("score", "range"), path, RUN)


def test_missing_cells_label_ids_and_empty_ranges(spark):
    rows = [("t", "b", "bug"), ("NA", "b", "bug"), ("t", "", "feature"), (None, "b", "feature"), ("t", "b", "null"), ("t", "b", None)]
    df = spark.createDataFrame([(*r, "2020_2020") for r in rows], "title string, body string, label string, period string")
    year = W.target_window("year", 2020, 2020)
    frame = W.load_model_frame(df, year, "year", label_ids=True, require_rows=True).collect()
    assert sorted((r.text, r.label, r.label_id) for r in frame) == [("", "bug", 0), ("", "feature", 1), ("", "feature", 1), ("t b", "bug", 0)]
    kept = W.load_model_frame(df, year, "year", null_as_empty=True).collect()
    assert len(kept) == 6 and sorted(r.text for r in kept)[:3] == [" b", " b", "t "]
    raw = W.load_model_frame(df, year, "year", na_cells=False).collect()
    assert "NA b" in {r.text for r in raw}
    with pytest.raises(ValueError, match="no test rows"):
        W.load_model_frame(df, year, "year", test=True, require_rows=True)
    assert W.load_model_frame(df, year, "year", test=True).count() == 0


def test_similarity_from_text_equals_its_steps(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i % 2}", i, f"2020-{1 + i % 5:02d}_2020-{1 + i % 5:02d}", " ".join(rng.choice(list("abcdefgh"), 6)), "xy"[i // 2 % 2])
            for i in range(160)] + [("p0", 500, "2020-05_2020-05", None, None)]
    df = spark.createDataFrame(rows, "project string, id long, period string, text string, label string")
    target = W.target_window("month", 2020, 2020, 1, 3)
    got = {(r.project, r.period): (r.num_samples, r.similarity) for r in jobs.monitor_text_similarity(
        df, target, "month", samples_per_class=9, id_col="id", dim=64, include_distribution=False).collect()}
    split = S.train_validation_split(W.train_windows(df, target), id_col="id", keys=["project"]).where("split = 'train'")
    train = S.sample_balanced(split, id_col="id", n=9, keys=["project"])
    vectors = {r.id: (r.project, np.array(r.embedding)) for r in M.embed_text(train, df, dim=64).collect()}
    chosen = {r.id for r in train.collect()}
    sums = {}
    for r in W.test_windows(df, target, "month").collect():
        mine = vectors[r.id][1]
        sims = [mine @ v for i, (p, v) in vectors.items() if i in chosen and p == r.project]
        sums.setdefault((r.project, r.period), []).append(np.mean(sims))
    assert got == {k: (len(v), pytest.approx(np.mean(v))) for k, v in sums.items()}
