"""Rows that used to be lost: unknown labels, untrained keys, null classes, date spellings."""

import datetime as dt

from pyspark.sql import functions as F

from driftmon.functions.dates import is_valid_date, parse_utc, parse_wall_clock
from driftmon.operators import model as M
from driftmon.operators import report as R
from driftmon.operators import sampling as S
from driftmon.operators import similarity as SIM


def test_scoring_keeps_every_row(spark):
    train = spark.createDataFrame([("good text here", "a"), ("bad words there", "b"), ("good again", "a"), ("x", None)], "text string, label string")
    test = spark.createDataFrame([("good", "a"), ("bad", "never seen"), (None, None)], "text string, label string")
    model = M.fit_classifier(train, num_features=256)
    out = M.score_classifier(model, test).collect()
    assert len(out) == 3 and all(r.y_pred in ("a", "b") for r in out)
    assert M.score_classifier(model, test.drop("label")).count() == 3


def test_untrained_keys_stay_with_null_similarity(spark):
    kind = "project string, vec_id long, embedding array<double>"
    train = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [0.0, 1.0])], kind)
    test = spark.createDataFrame([("p", 7, [1.0, 0.0]), ("p", 7, [-1.0, -1.0]), ("q", 8, [1.0, 0.0]), (None, 9, [1.0, 1.0])], kind)
    for mode in ("mean", "max"):
        got = {(r.project, r.vec_id, r.embedding[0]): r.sim for r in SIM.similarity_per_row(test, train, mode).collect()}
        assert len(got) == 4 and got[("q", 8, 1.0)] is None and got[(None, 9, 1.0)] is None
    assert abs(got[("p", 7, -1.0)] + 0.5**0.5) < 1e-9 and got[("p", 7, 1.0)] == 1
    assert SIM.similarity_per_row(test, train, "max", keys=()).where("sim is not null").count() == 4
    assert SIM.similarity_per_row(test, train, "mean", keys=()).where("sim is not null").count() == 4


def test_split_keeps_null_classes_and_ids(spark):
    rows = [(i, "a" if i % 2 else "b") for i in range(20)] + [(None, "a"), (30, None), (None, None)]
    out = S.train_validation_split(spark.createDataFrame(rows, "id long, label string"))
    assert out.count() == len(rows) and out.where("split = 'validation'").count() == 7


def test_every_accepted_date_form_is_parsed(spark):
    utc = {
        "2021-12-14T16:45:26.000+0000": (16, 16), "2021-12-14T16:45:26Z": (16, 16), "2021-12-14T16:45:26+02:00": (16, 14),
        "2021-12-14 16:45": (16, 16), "2021-12-14": (0, 0), "20211214T164526": (16, 16), "20211214": (0, 0),
        "2021-12-14T16:45:26,123456789-0500": (16, 21), "2021-12-14T16:45:26.1234567+01": (16, 15), "20211214T164526.5Z": (16, 16),
    }
    df = spark.createDataFrame([(k,) for k in [*utc, "2021-13-14", "14.12.2021", "", None, "2021-12-14T25:00"]], "x string")
    rows = df.select("x", is_valid_date("x").alias("ok"), parse_wall_clock("x").cast("string").alias("wall"),
                     parse_utc("x").cast("string").alias("utc")).collect()
    for r in rows:
        assert r.ok == (r.x in utc)
        if r.ok:
            hour = [dt.datetime.fromisoformat(t[:19]).hour for t in (r.wall, r.utc)]
            assert tuple(hour) == utc[r.x], r
        else:
            assert r.wall is None and r.utc is None


def test_report_of_a_window_without_the_labels_asked_for(spark):
    pred = spark.createDataFrame([("p", "w1", "a", "a"), ("p", "w2", "c", "c")], "project string, period string, y_true string, y_pred string")
    out = R.report_by_window(pred, labels=["a", "b"]).where(F.col("class") == "accuracy")
    assert {r.period: r.f1_score for r in out.where("scope = 'window'").collect()} == {"w1": 1.0, "w2": 0.0}


def test_samples_without_ids_do_not_depend_on_partitions(spark):
    rows = [(i if i % 3 else None, "ab"[i % 2], f"text {i}") for i in range(120)] + [(5, "a", "again"), (5, "a", "and again")]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    for id_col in ("id", None):
        one = S.sample_per_class(df.repartition(1), id_col=id_col, n=15).collect()
        many = S.sample_per_class(df.repartition(9, "text"), id_col=id_col, n=15).collect()
        assert len(one) == 30 and sorted(r.text for r in one) == sorted(r.text for r in many)


def test_a_label_without_an_id_is_an_error(spark):
    import pytest

    from driftmon.functions.labels_index import index_labels, label_dictionary

    df = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    got = {r.label: r.label_id for r in index_labels(df, label_dictionary(df)).collect()}
    assert got == {"a": 0, "b": 1, None: None}
    with pytest.raises(Exception, match="label without an id"):
        index_labels(df, label_dictionary(df, labels=["a"])).collect()
