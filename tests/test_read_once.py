"""Rows that several steps read are computed once; norms and window labels are not computed over and over."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftmon.operators import model as M
from driftmon.operators import sampling as S
from driftmon.operators import similarity as SIM
from driftmon.operators import windows as W
from driftmon.plans import jobs
from driftmon.sources import fixtures


def _counted(spark, df, column):
    """``df`` with ``column`` passed through a function that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(same, "string")(column)), seen


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("take", [
    lambda df: S.sample_per_class(df, id_col=None, n=5), lambda df: S.sample_balanced(df, id_col="id", n=5, keys=["project"]),
    lambda df: S.sample_stratified(df, id_col="id", n=5), lambda df: S.train_validation_split(df, id_col="id", keys=["project"])])
def test_sampled_rows_are_computed_once(spark, take):
    rows = [(i, f"p{i % 2}", "ab"[i // 2 % 2], f"text {i}") for i in range(80)]
    df, seen = _counted(spark, spark.createDataFrame(rows, "id long, project string, label string, text string"), "text")
    got = take(df)
    assert {r.text for r in got.collect()} <= {r[3] for r in rows} and got.columns[:4] == df.columns
    assert seen.value == len(rows)
    again = S.sample_balanced(got.select(df.columns), id_col="id", n=4, keys=["project"])
    assert len(_plan(again)) < 20_000 and "udf" not in _plan(again).lower()  # a step's plan starts at written rows


def test_a_fit_computes_its_rows_once(spark):
    rows = [(f"{'good' if i % 2 else 'bad'} word{i % 5}", "ab"[i % 2]) for i in range(40)] + [("x", None), (None, "a")]
    df, seen = _counted(spark, spark.createDataFrame(rows, "text string, label string"), "text")
    model = M.fit_classifier(df, num_features=64)
    assert seen.value <= len(rows)
    assert {r.text: r.y_pred for r in M.score_classifier(model, spark.createDataFrame(rows[:2], "text string, label string")).collect()} == {
        "bad word0": "a", "good word1": "b"}


@pytest.mark.parametrize("sampling", [None, "balanced"])
def test_monitored_windows_are_computed_once(spark, sampling):
    rows = [(f"p{i % 2}", "t", f"{'good' if i // 2 % 2 else 'bad'} {i}", "xy"[i // 2 % 2], f"{2018 + i % 5}_{2018 + i % 5}") for i in range(120)]
    df, seen = _counted(spark, spark.createDataFrame(rows, "project string, title string, body string, label string, period string"), "body")
    report, scored, _ = jobs.monitor_classifier(df, W.target_window("year", 2019, 2020), "year", sampling=sampling, samples_per_class=6)
    assert {r.period: r.support for r in report.where("class = 'accuracy' and project = 'p0'").collect()} == {"2021_2021": 12, "2022_2022": 12, None: 24}
    assert scored.count() == 48 and seen.value <= len(rows)


@pytest.mark.parametrize("rule", ["similarity", "evaluation"])
def test_train_and_test_windows_in_one_frame(spark, rule):
    labels = [f"{y}-{m:02d}_{y}-{m:02d}" for y in (2019, 2020, 2021) for m in range(1, 13)] + ["2020-11_2021-02", "not a window", None]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "period string, id long")
    target = W.target_window("month", 2020, 2020, 3, 11)
    both = {r.id for r in W.train_windows(df, target).collect()} | {r.id for r in W.test_windows(df, target, "month", rule).collect()}
    got = [r.id for r in W.train_and_test_windows(df, target, "month", rule).collect()]
    assert sorted(got) == sorted(both) and len(both) == 23


def test_unit_vectors_compute_their_norm_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None])], "id long, v array<double>")
    out = df.select("id", SIM.unit_vector("v").alias("u"))
    assert {r.id: r.u for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [], 5: [0.0, None]}
    assert _plan(out).lower().count("sqrt(") == 1


def test_window_labels_are_parsed_for_joined_rows_only(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    days = [(i, dt.datetime(1994 + i % 4, 5, 1)) for i in range(50)]
    spark.createDataFrame(days, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    rows = W.train_windows(fixtures.labelled_text(spark, str(tmp_path)), W.target_window("year", 1995, 1996))
    assert sorted((r.doc_id, r.period) for r in rows.collect()) == [
        (1, "1995-05_1995-05"), (2, "1996-05_1996-05"), (5, "1995-05_1995-05")]
    lines = _plan(rows).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert any("RLIKE" in x for x in lines[:join]) and not any("RLIKE" in x for x in lines[join:])
