"""Operators against brute force on small frames, plus plan checks."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmon.functions import numeric as K
from driftmon.operators import report as R
from driftmon.operators import sampling as SM
from driftmon.operators import similarity as SIM
from driftmon.operators import stats as ST


def test_report_zero_division_and_class_presence(spark):
    rows = [("P", "w1", "bug", "bug"), ("P", "w1", "bug", "feature"), ("P", "w2", "question", "question")]
    pred = spark.createDataFrame(rows, "project string, period string, y_true string, y_pred string")
    rep = {(r.scope, r.period, r["class"]): r for r in R.report_by_window(pred).collect()}
    # 'feature' is predicted in w1 but never true: precision 0, recall 0, f1 0
    f = rep[("window", "w1", "feature")]
    assert (f.precision, f.recall, f.f1_score, f.support) == (0.0, 0.0, 0.0, 0)
    b = rep[("window", "w1", "bug")]
    assert (b.precision, b.recall, round(b.f1_score, 6), b.support) == (1.0, 0.5, round(2 / 3, 6), 2)
    # macro avg over the classes present in w1 only (bug, feature)
    assert rep[("window", "w1", "macro avg")].f1_score == pytest.approx((2 / 3 + 0) / 2)
    assert ("window", "w2", "bug") not in rep  # class absent from a window is not reported there
    assert rep[("window", "w2", "accuracy")].f1_score == 1.0
    assert rep[("overall", None, "accuracy")].f1_score == pytest.approx(2 / 3)


def _brute_first(ids, labels, n, seed=42):
    out = {}
    for lab in set(labels):
        members = sorted((hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i) for i, l in zip(ids, labels) if l == lab)
        out[lab] = [i for _, i in members]
    return out


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sampling_matches_brute_force_and_ignores_partitioning(spark, parts):
    rng = np.random.default_rng(1)
    labels = rng.choice(["a", "b", "c"], size=3000, p=[0.7, 0.25, 0.05]).tolist()
    ids = list(range(3000))
    df = spark.createDataFrame(list(zip(ids, labels)), "id long, label string").repartition(parts)
    ordered = _brute_first(ids, labels, 0)
    got = {r.id for r in SM.sample_per_class(df, n=40).collect()}
    assert got == {i for lab in ordered for i in ordered[lab][:40]}
    smallest = min(len(v) for v in ordered.values())
    got = {r.id for r in SM.sample_balanced(df, n=1000).collect()}
    assert got == {i for lab in ordered for i in ordered[lab][:smallest]}
    split = SM.train_validation_split(df, split_size=0.3)
    assert split.where("split = 'validation'").count() == int(np.ceil(0.3 * 3000))


def test_stratified_total_larger_than_data_returns_all(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "id long, label string")
    assert SM.sample_stratified(df, n=100).count() == 30


def _vectors(spark, rng, n, dim, start_id, project="P"):
    v = rng.normal(size=(n, dim))
    v[0] = 0.0  # a zero vector has cosine 0 with everything
    rows = [(start_id + i, project, "w", v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, project string, period string, embedding array<double>"), v


def _unit(m):
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def test_mean_similarity_centroid_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    train, a = _vectors(spark, rng, 60, 8, 0)
    test, b = _vectors(spark, rng, 40, 8, 1000)
    got = {r.vec_id: r.sim for r in SIM.mean_similarity_per_row(test, train).collect()}
    brute = (_unit(b) @ _unit(a).T).mean(axis=1)
    assert np.allclose([got[1000 + i] for i in range(40)], brute, atol=1e-12)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_max_similarity_equals_all_pairs(spark, limit):
    rng = np.random.default_rng(8)
    train, a = _vectors(spark, rng, 90, 6, 0)
    test, b = _vectors(spark, rng, 50, 6, 1000)
    rows = SIM.max_similarity_per_row(test, train, block_rows=16, chunk_rows=7, broadcast_bytes=limit).collect()
    got = {r.vec_id: r.sim for r in rows}
    brute = (_unit(b) @ _unit(a).T).max(axis=1)
    assert len(got) == 50
    assert np.allclose([got[1000 + i] for i in range(50)], brute, atol=1e-12)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_max_similarity_of_messy_vectors(spark, limit):
    kind = "project string, vec_id long, extra string, _key int, embedding array<double>"
    nan = float("nan")
    train = spark.createDataFrame([("p", 1, "t", 0, [1.0, 0.0]), ("p", 1, "t", 0, [1.0, 0.0]), ("p", 2, "t", 0, None),
                                   ("p", 3, "t", 0, [None, 1.0]), ("p", 4, "t", 0, [nan, 1.0]), ("p", 5, "t", 0, []),
                                   ("p", 6, "t", 0, [0.0, 0.0, 2.0]), (None, 7, "t", 0, [0.0, 0.0])], kind)
    rows = [("p", 1, "a", 1, [2.0, 0.0], 1.0), ("p", 1, "b", 2, [2.0, 0.0], 1.0), ("p", 1, "c", 3, [-1.0, 0.0], -1.0),
            ("p", None, "d", 4, [0.0, 0.0], 0.0), ("p", 2, "e", 5, None, None), ("p", 2, "f", 6, [None, 1.0], None),
            ("p", 2, "g", 7, [nan, 1.0], None), ("p", 2, "h", 8, [], None), ("p", 3, "i", 9, [0.0, 3.0, 4.0], 0.8),
            ("p", 3, "j", 10, [1.0] * 4, None), ("q", 3, "k", 11, [1.0, 0.0], None), (None, 3, "l", 12, [1.0, 1.0], 0.0)]
    test = spark.createDataFrame([r[:5] for r in rows], kind)
    out = SIM.max_similarity_per_row(test, train, broadcast_bytes=limit)
    assert out.columns == [*test.columns, "sim"]
    got = {r.extra: (r._key, r.sim) for r in out.collect()}
    assert got == {r[2]: (r[3], r[5] if r[5] is None else pytest.approx(r[5])) for r in rows}
    assert SIM.max_similarity_per_row(test.limit(0), train, broadcast_bytes=limit).count() == 0
    nothing = SIM.max_similarity_per_row(test, train.limit(0), broadcast_bytes=limit).collect()
    assert len(nothing) == len(rows) and all(r.sim is None for r in nothing)


def test_blocks_that_cannot_win_are_skipped():
    from driftmon.operators import vector_blocks as V

    class Counted(np.ndarray):
        used = 0

        @property
        def T(self):
            Counted.used += 1
            return np.asarray(self).T

    rng = np.random.default_rng(5)
    spots = _unit(rng.normal(size=(12, 24)))
    blocks = [_unit(s + rng.normal(scale=0.02, size=(40, 24))) for s in spots]
    centroids = np.stack([b.mean(axis=0) for b in blocks])
    radii = np.array([np.linalg.norm(b - c, axis=1).max() for b, c in zip(blocks, centroids)])
    test = _unit(spots[3] + rng.normal(scale=0.02, size=(30, 24)))
    got = V._best(test, [b.view(Counted) for b in blocks], centroids, radii)
    assert np.allclose(got, (test @ np.concatenate(blocks).T).max(axis=1), atol=1e-12)
    assert Counted.used == 1


def test_max_similarity_never_shuffles_the_test_side(spark):
    rng = np.random.default_rng(9)
    train, _ = _vectors(spark, rng, 30, 4, 0)
    test, _ = _vectors(spark, rng, 20, 4, 1000)
    plan = SIM.max_similarity_per_row(test, train)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_distribution_matches_numpy(spark):
    vals = np.random.default_rng(3).normal(size=101)
    df = spark.createDataFrame([("k", float(v)) for v in vals], "k string, sim double")
    row = SIM.summarise(df, ["k"]).first()
    assert row.dist_p10 == pytest.approx(np.percentile(vals, 10))
    assert row.dist_median == pytest.approx(np.median(vals))
    assert row.dist_std == pytest.approx(np.std(vals))


def test_spearman_equals_pearson_of_average_ranks(spark):
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0, 8.0]
    y = [2.0, 1.0, 4.0, 3.0, 7.0, 6.0, 6.0, 9.0]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(x, y)], "project string, x double, y double")
    rho = ST.spearman(df, "x", "y").first()

    def avg_rank(v):
        order = np.argsort(v, kind="mergesort")
        ranks = np.empty(len(v))
        ranks[order] = np.arange(1, len(v) + 1)
        for val in set(v):
            idx = [i for i, t in enumerate(v) if t == val]
            ranks[idx] = ranks[idx].mean()
        return ranks

    expect = np.corrcoef(avg_rank(x), avg_rank(y))[0, 1]
    assert rho.r == pytest.approx(expect)
    assert 0.0 <= rho.p <= 1.0


def test_constant_series_gives_null_r(spark):
    df = spark.createDataFrame([("k", 1.0, float(i)) for i in range(5)], "project string, x double, y double")
    assert ST.pearson(df, "x", "y").first().r is None


def test_minmax_does_not_change_correlation_or_shapiro(spark):
    from driftmon.operators import series as SE

    rng = np.random.default_rng(5)
    rows = [("k", f"2000-{m:02d}_2000-{m:02d}", float(a), float(b))
            for m, (a, b) in enumerate(rng.normal(size=(12, 2)), start=1)]
    df = spark.createDataFrame(rows, "project string, period string, x double, y double")
    scaled = SE.minmax_scale(df, ["x", "y"])
    r1 = ST.pearson(df, "x", "y").first().r
    r2 = ST.pearson(scaled, "x_normalized", "y_normalized").first().r
    assert r1 == pytest.approx(r2)
    n = {r.variable: r.shapiro_statistic for r in ST.check_normality(scaled, ["x", "x_normalized"]).collect()}
    assert n["x"] == pytest.approx(n["x_normalized"])


def test_histogram_matches_numpy(spark):
    vals = np.random.default_rng(11).gamma(2.0, size=257)
    df = spark.createDataFrame([("k", float(v)) for v in vals], "project string, v double")
    got = sorted(ST.density_histogram(df, "v").collect(), key=lambda r: r.bin)
    dens, edges = np.histogram(vals, bins="auto", density=True)
    assert len(got) == len(dens)
    assert np.allclose([r.density for r in got], dens)
    assert np.allclose([r.bin_left for r in got], edges[:-1])


def test_kernels_properties():
    x = np.random.default_rng(0).normal(size=30)
    w, p = K.shapiro(x)
    assert 0.9 < w <= 1.0 and 0.0 <= p <= 1.0
    assert K.shapiro(x * 4 - 2)[0] == pytest.approx(w)
    assert K.correlation_p_value(0.0, 12) == pytest.approx(1.0)
    assert K.correlation_p_value(1.0, 12) == 0.0
    a = np.sin(np.linspace(0, 6, 40))
    b = np.sin(np.linspace(0.3, 6.3, 35))
    assert K.fastdtw(a, a)[0] == 0.0
    exact, fast = K.dtw_exact(a, b)[0], K.fastdtw(a, b)[0]
    assert exact <= fast + 1e-12
    assert K.dtw_exact(b, a)[0] == pytest.approx(exact)
    path = K.fastdtw(a, b)[1]
    assert path[0] == (0, 0) and path[-1] == (39, 34)


def test_mean_mode_plan_broadcasts_centroid_only(spark):
    rng = np.random.default_rng(9)
    train, _ = _vectors(spark, rng, 20, 4, 0)
    test, _ = _vectors(spark, rng, 20, 4, 1000)
    plan = SIM.mean_similarity_per_row(test, train)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_window_read_prunes_partitions(spark, tmp_path):
    from driftmon.operators import windows as W
    from driftmon.sources import issues_io

    rows = [("t", "b", "bug", "2000-01-05T00:00:00.000+0000", "P"), ("t", "b", "bug", "2003-02-05T00:00:00.000+0000", "P")]
    df = spark.createDataFrame(rows, "title string, body string, label string, date string, project string")
    w = W.create_time_windows(df, "year", 1)
    path = str(tmp_path / "w")
    issues_io.write_windows(w, path)
    back = issues_io.read_windows(spark, path, "year", 1)
    sel = W.test_windows(back, W.target_window("year", 2000, 2001), "year")
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and sel.count() == 1
    assert [r.period for r in sel.collect()] == ["2003_2003"]
