"""Quantiles by order statistics against NumPy, and their plans."""

from __future__ import annotations

import random

import numpy as np

from driftmon.operators import similarity as SIM
from driftmon.operators import stats as ST
from driftmon.operators.quantiles import ordered_values, quantiles_of


def groups(seed):
    rng = random.Random(seed)
    out = {("a", 1): [0.5], ("a", 2): [1.0, 2.0], (None, 1): [3.0, 1.0, 2.0], ("c", 9): [None, None], ("b", None): [7.0] * 40 + [None]}
    out |= {("g", k): [rng.choice([rng.random(), 0.25, -1.0]) for _ in range(rng.randrange(3, 60))] for k in range(12)}
    out[("hot", 0)] = [rng.gauss(0, 1) for _ in range(4000)]
    return out


def test_equal_to_numpy(spark):
    data = groups(3)
    rows = [(*k, v, "x") for k, vs in data.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "project string, k int, sim double, at string").repartition(6)
    names = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {(r.project, r.k): r for r in quantiles_of(ordered_values(df, ["project", "k"], "sim"), ["project", "k"], names).collect()}
    assert set(got) == {k for k, vs in data.items() if any(v is not None for v in vs)}
    for k, r in got.items():
        own = [v for v in data[k] if v is not None]
        for name, q in names.items():
            assert np.isclose(r[name], np.quantile(own, q), rtol=0, atol=1e-12), (k, name)


def test_distribution_rows(spark):
    data = groups(4)
    df = spark.createDataFrame([(*k, v) for k, vs in data.items() for v in vs], "project string, period int, sim double").repartition(5)
    exact = {(r.project, r.period): r for r in SIM.summarise(df, ["project", "period"]).collect()}
    assert len(exact) == len(data)
    for k, r in exact.items():
        own = [v for v in data[k] if v is not None]
        assert r.num_samples == len(data[k])
        if not own:
            assert r.similarity is None and r.dist_median is None and r.dist_min is None
            continue
        want = [np.mean(own), np.mean(own), np.std(own), np.min(own), *np.quantile(own, SIM.QUANTILES), np.max(own)]
        assert np.allclose(tuple(r)[3:], want)
    assert SIM.summarise(df, ["project", "period"], exact=False).columns == SIM.summarise(df, ["project", "period"]).columns


def test_no_percentile_in_the_plans(spark, capsys):
    df = spark.range(50).selectExpr("'p' as project", "cast(id as double) as sim")
    for out in (SIM.summarise(df, ["project"]), ST.density_histogram(df, "sim")):
        out.explain("extended")
        assert "percentile(" not in capsys.readouterr().out.lower()


def test_empty(spark):
    none = spark.createDataFrame([], "project string, sim double")
    assert SIM.summarise(none, ["project"]).count() == 0
    assert ST.density_histogram(none, "sim").count() == 0
