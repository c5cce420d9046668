"""Normality tests and plot points from distributed ranks against the one-series kernels."""

from __future__ import annotations

import math

import numpy as np
import pytest

from driftmon.functions import numeric as K
from driftmon.operators import normality as N

SCHEMA = "project string, x double"


def _series():
    rng = np.random.default_rng(17)
    out = {f"n{n}": rng.normal(3.0, 2.0, n) for n in (1, 2, 3, 4, 5, 6, 7, 11, 12, 40, 41)}
    out["skewed"] = rng.exponential(size=300)
    out["ties"] = np.round(rng.normal(size=200), 1)
    out["constant"] = np.full(9, 0.1)
    out["far"] = rng.normal(1e6, 1e-2, 60)
    out["outlier"] = np.append(rng.normal(size=2000), 1e9)
    out["hot"] = rng.normal(size=4000)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, float(v)) for k, values in _series().items() for v in values]
    rows += [("n12", None), ("n12", float("nan")), ("holes", None), ("holes", float("nan")), (None, 1.0), (None, 2.0), (None, 4.0)]
    order = np.random.default_rng(1).permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(7).cache()


def test_statistics_equal_the_kernels(frame):
    got = {r.project: r for r in N.check_normality(frame, ["x"]).collect()}
    series = _series() | {None: np.array([1.0, 2.0, 4.0])}
    assert set(got) == set(series)  # a series of holes alone has no row
    for k, v in series.items():
        row = got[k]
        assert row.n == v.size and row.variable == "x"
        if v.size < 3:
            assert row.shapiro_statistic is None and row.shapiro_p_value is None and row.is_normal is None
            assert row.anderson_statistic is None and row.anderson_critical_values == []
            continue
        w, p = K.shapiro(v)
        assert row.shapiro_statistic == pytest.approx(w, rel=1e-7), k
        assert row.shapiro_p_value == pytest.approx(p, rel=1e-4, abs=1e-12), k
        assert row.is_normal == (p > 0.05)
        if k == "constant":
            assert row.anderson_statistic is None and row.anderson_critical_values == []
            continue
        assert math.isfinite(row.anderson_statistic)
        if k != "outlier":  # the kernel's tail is infinite there
            a2, crit = K.anderson_normal(v)
            assert row.anderson_statistic == pytest.approx(a2, rel=1e-6, abs=1e-8), k
            assert row.anderson_critical_values == pytest.approx(crit, abs=1e-9)


def test_plot_points_equal_the_kernel(frame):
    got: dict = {}
    for r in N.qq_points(frame, ["x"]).collect():
        got.setdefault(r.project, []).append(r)
    for k, v in _series().items():
        rows = sorted(got[k], key=lambda r: r.i)
        osm, osr, slope, intercept, r = K.probplot(v)
        assert [x.i for x in rows] == list(range(1, v.size + 1))
        assert [x.ordered for x in rows] == osr.tolist()
        if v.size == 1:
            assert rows[0].theoretical == pytest.approx(0.0, abs=1e-12) and rows[0].slope is None and rows[0].r is None
            continue
        assert np.allclose([x.theoretical for x in rows], osm, atol=1e-12)
        if k == "constant":
            assert rows[0].slope == 0.0 and rows[0].r == 0.0 and rows[0].intercept == pytest.approx(0.1)
            continue
        assert rows[0].slope == pytest.approx(slope, rel=1e-7), k
        assert rows[0].intercept == pytest.approx(intercept, rel=1e-7, abs=1e-7), k
        assert rows[-1].r == pytest.approx(r, rel=1e-7), k


def test_no_series_is_one_python_group(frame):
    plan = N.check_normality(frame, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan
    assert "ArrowEvalPython" in plan and "partial_sum" in plan


def test_empty_table_and_several_columns(spark):
    empty = spark.createDataFrame([], "project string, x double, y double")
    assert N.check_normality(empty, ["x", "y"]).count() == 0
    assert N.qq_points(empty, ["x"]).count() == 0
    two = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(20)], "project string, x double, y double")
    got = {r.variable: r.shapiro_statistic for r in N.check_normality(two, ["x", "y"]).collect()}
    assert got == {"x": pytest.approx(K.shapiro(np.arange(20.0))[0]), "y": pytest.approx(K.shapiro(np.arange(20.0) ** 2)[0])}


def test_log_of_the_distribution_function_far_out():
    x = np.array([-500.0, -40.0, -37.001, -36.999, -5.0, 0.0, 9.0])
    got = K.norm_logcdf(x)
    assert np.all(np.isfinite(got)) and np.all(np.diff(got) >= 0)
    assert got[2] == pytest.approx(math.log(0.5 * math.erfc(37.001 / math.sqrt(2))), rel=1e-8)
    assert got[4] == pytest.approx(math.log(0.5 * math.erfc(5 / math.sqrt(2))))
