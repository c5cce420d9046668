"""One model per key in one job against separate fits and a plain minimiser."""

import datetime as dt

import numpy as np
import pytest

from driftmon.operators import keyed_model as K
from driftmon.operators import report as R
from driftmon.operators import windows as W

KIND = "project string, id long, text string, label string"


def _texts(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    words = {"bug": ["crash", "error", "fails", "null"], "feature": ["add", "please", "support", "wish"], "question": ["how", "why", "what", "where"]}
    classes = {"p": ["bug", "feature"], "q": ["bug", "feature", "question"], None: ["feature", "question"]}
    rows = []
    for i in range(n):
        project = ["p", "q", None][i % 3]
        label = str(rng.choice(classes[project]))
        said = [*rng.choice(words[label], 2), *rng.choice(sum(words.values(), []), 3), "the"]
        rows.append((project, i, " ".join(map(str, said)), label))
    return spark.createDataFrame(rows, KIND), rows


def test_joint_fit_equals_separate_fits(spark):
    df, rows = _texts(spark)
    joint = K.fit_keyed(df, num_features=64, reg=0.05)
    split = K.fit_keyed(df, num_features=64, reg=0.05, model_bytes=1)  # a fit for each key
    assert len(joint.groups) == 1 and len(split.groups) == 3
    alone = {k: v for group in split.groups for k, v in group.items()}
    for key, (classes, matrix) in joint.groups[0].items():
        assert classes == alone[key][0]
        assert np.allclose(matrix, alone[key][1], atol=2e-3)
    one = {r.id: r.y_pred for r in K.score_keyed(joint, df).collect()}
    other = {r.id: r.y_pred for r in K.score_keyed(split, df).collect()}
    assert one == other and len(one) == len(rows)
    assert all(one[r[1]] != "question" for r in rows if r[0] == "p")
    assert np.mean([one[r[1]] == r[3] for r in rows]) > 0.8


def test_coefficients_minimise_the_stated_loss(spark):
    df, rows = _texts(spark, 90)
    reg, d = 0.1, 32
    model = K.fit_keyed(df, num_features=d, reg=reg)
    buckets = {r.id: r.w for r in df.select("id", K.word_buckets("text", d).alias("w")).collect()}
    for key, project in zip(sorted(model.groups[0]), sorted({r[0] or "" for r in rows}, key=lambda p: (p != "", p))):
        mine = [r for r in rows if (r[0] or "") == project]
        x = np.zeros((len(mine), d + 1))
        for i, r in enumerate(mine):
            x[i, buckets[r[1]]] = 1 / np.sqrt(len(buckets[r[1]]))
            x[i, d] = 1
        y = np.eye(3)[[model.labels.index(r[3]) for r in mine]]
        matrix = next(m for k, (_, m) in model.groups[0].items() if (f'"project":"{project}"' in k if project else "project" not in k))
        z = x @ matrix.T
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        gradient = (prob - y).T @ x / len(mine) + reg * matrix
        assert np.abs(gradient).max() < 1e-3


def test_keyed_scores_keep_every_row(spark):
    df, _ = _texts(spark, 60)
    model = K.fit_keyed(df, num_features=64)
    odd = spark.createDataFrame([("p", 1, None, None, "k", 1), ("p", 1, "", "bug", "k", 2), ("z", 2, "crash", "bug", "k", 3),
                                 (None, None, "how " * 5000, "never seen", "k", 4), ("p", 1, "", "bug", "k", 2)],
                                KIND + ", _key string, _words int")
    out = K.score_keyed(model, odd)
    assert out.columns == ["project", "id", "text", "y_true", "_key", "_words", "y_pred"]
    got = sorted((r._words, r.y_pred) for r in out.collect())
    assert [w for w, _ in got] == [1, 2, 2, 3, 4] and got[3][1] is None and all(p for w, p in got if w != 3)
    assert got[4][1] == "question"
    empty = K.fit_keyed(df.limit(0), num_features=64)
    assert all(r.y_pred is None for r in K.score_keyed(empty, odd).collect())
    single = K.fit_keyed(df.where("label = 'bug'"), num_features=64)
    assert {r.y_pred for r in K.score_keyed(single, df.where("project = 'p'")).collect()} == {"bug"}
    with pytest.raises(ValueError):
        K.fit_keyed(df, reg=0.0)


def test_validation_equals_a_loop_of_single_fits(spark):
    df, _ = _texts(spark)
    grid = (1.0, 0.05)
    _, curve = K.fit_validated(df, candidates=grid, num_features=64)
    got = {(r.project, r.reg): r for r in curve.collect()}
    rows = K.train_validation_split(df, "label", "id", 0.3, 42, ["project"]).cache()
    for reg in grid:
        scored = K.score_keyed(K.fit_keyed(rows.where("split = 'train'"), num_features=64, reg=reg), rows.where("split = 'validation'"))
        for r in R.classification_report(scored).where("class = 'macro avg'").collect():
            mine = got[r.project, reg]
            assert mine.n_validation == r.support and mine.f1_macro == pytest.approx(r.f1_score)
    for project in ("p", "q", None):
        best = max(((got[project, c].f1_macro, c) for c in grid))[1]
        assert [c for c in grid if got[project, c].chosen] == [best]


def test_ranges_by_key(spark):
    df = spark.createDataFrame([(p, f"2020-{m:02d}_2020-{m:02d}") for p in ("a", "b", "c", None) for m in range(1, 7)],
                               "project string, period string")
    ranges = spark.createDataFrame([("a", dt.date(2020, 1, 1), dt.date(2020, 2, 29)), ("b", dt.date(2020, 3, 10), dt.date(2020, 4, 2)),
                                    (None, dt.date(2020, 6, 1), dt.date(2020, 6, 30))], "project string, train_start date, train_end date")

    def months(frame):
        out = {}
        for r in frame.collect():
            out.setdefault(r.project, []).append(int(r.period[-2:]))
        return {k: sorted(v) for k, v in out.items()}

    assert months(W.train_windows_by_key(df, ranges)) == {"a": [1, 2], "b": [3, 4], None: [6]}
    assert months(W.test_windows_by_key(df, ranges, "month")) == {"a": [3, 4, 5, 6], "b": [5, 6]}
    assert months(W.test_windows_by_key(df, ranges, "month", rule="evaluation")) == {"a": [2, 3, 4, 5, 6], "b": [4, 5, 6], None: [6]}
    assert W.train_windows_by_key(df, ranges).columns == df.columns
