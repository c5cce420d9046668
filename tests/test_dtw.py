"""DTW kernels against a plain table over sets of cells."""

import time

import numpy as np
import pytest

from driftmon.functions import numeric as K


def _plain(x, y, cells):
    cost, back = {}, {}
    for i, j in sorted(cells):
        ways = [(cost.get((i - 1, j), np.inf), 0), (cost.get((i, j - 1), np.inf), 1),
                (0.0 if (i, j) == (0, 0) else cost.get((i - 1, j - 1), np.inf), 2)]
        best, step = min(ways, key=lambda w: w[0])
        cost[i, j], back[i, j] = best + abs(x[i] - y[j]), step
    i, j = len(x) - 1, len(y) - 1
    total, path = cost[i, j], []
    while i >= 0 and j >= 0:
        path.append((i, j))
        step = back[i, j]
        i, j = i - (step != 1), j - (step != 0)
    return total, path[::-1]


def _plain_fast(x, y, radius):
    everything = {(i, j) for i in range(len(x)) for j in range(len(y))}
    if len(x) < radius + 2 or len(y) < radius + 2:
        return _plain(x, y, everything)
    half = [(v[0:2 * (len(v) // 2):2] + v[1:2 * (len(v) // 2):2]) / 2 for v in (x, y)]
    _, coarse = _plain_fast(*half, radius)
    near = {(i + a, j + b) for i, j in coarse for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)}
    cells = {(2 * i + a, 2 * j + b) for i, j in near for a in (0, 1) for b in (0, 1)}
    return _plain(x, y, cells & everything)


@pytest.mark.parametrize("seed", range(25))
def test_kernels_equal_the_plain_table(seed):
    rng = np.random.default_rng(seed)
    x, y = (rng.integers(0, 6, rng.integers(1, 40)).astype(float) for _ in range(2))
    everything = {(i, j) for i in range(x.size) for j in range(y.size)}
    assert K.dtw_exact(x, y) == _plain(x, y, everything)
    for radius in (1, 2, 3):
        assert K.fastdtw(x, y, radius) == _plain_fast(x, y, radius)


def test_long_series_take_linear_time():
    rng = np.random.default_rng(0)
    x, y = np.cumsum(rng.normal(size=20000)), np.cumsum(rng.normal(size=20001))
    t0 = time.perf_counter()
    distance, path = K.fastdtw(x, y)
    assert time.perf_counter() - t0 < 20
    assert path[0] == (0, 0) and path[-1] == (19999, 20000) and len(path) < 40001
    assert distance == pytest.approx(sum(abs(x[i] - y[j]) for i, j in path))


def test_empty_series():
    assert K.dtw_exact([], []) == (0.0, []) and K.fastdtw([], [1.0]) == (float("inf"), [])
