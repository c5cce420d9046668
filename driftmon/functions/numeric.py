"""NumPy kernels for the statistics (no SciPy in the environment).

These run inside ``applyInPandas`` / pandas UDFs, one series per call; the
series are per-window tables (one value per period), so they are small, and
Spark parallelises over the many series (projects x models x ranges).

Sources: the regularised incomplete beta by Lentz's continued fraction
(Numerical Recipes 6.4); Shapiro-Wilk W and its p-value by Royston's
algorithm AS R94 (1995); Anderson-Darling for the normal with Stephens'
(1974) finite-sample critical values; Filliben's (1975) order statistic
medians for the probability plot; FastDTW (Salvador & Chan, 2007).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_STD = NormalDist()


# --------------------------------------------------------------- distributions
def norm_cdf(x):
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2.0)) if x.size else x


def norm_sf(x):
    return norm_cdf(-np.asarray(x, dtype=float))


def norm_ppf(p):
    p = np.asarray(p, dtype=float)
    return np.vectorize(_STD.inv_cdf, otypes=[float])(p) if p.size else p


def norm_logcdf(x):
    """Logarithm of the normal distribution function, finite far below where the function is zero in doubles."""
    x = np.asarray(x, dtype=float)
    far = x < -37.0
    near = np.log(norm_cdf(np.where(far, 0.0, x)))
    t = np.where(far, x, -37.0)
    return np.where(far, -0.5 * t * t - np.log(-t * math.sqrt(2.0 * math.pi)) + np.log1p(-1.0 / (t * t)), near)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _betacf(b, a, 1.0 - x) / b


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def correlation_p_value(r, n) -> float | None:
    """Two-sided p of a correlation coefficient under H0 (Student t, n-2 df)."""
    if r is None or n is None or (isinstance(r, float) and math.isnan(r)):
        return None
    n = int(n)
    if n < 2:
        return None
    if n == 2:
        return 1.0
    r = max(-1.0, min(1.0, float(r)))
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    return betainc(df / 2.0, 0.5, df / (df + t2))


# ------------------------------------------------------------------ normality
def _poly(c, x):
    out = 0.0
    for k, ck in enumerate(c):
        out += ck * x ** k
    return out


# Royston's polynomial coefficients (AS R94).
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


def shapiro_coefficients(n: int) -> np.ndarray:
    """The positive half of the Shapiro-Wilk weights (largest first)."""
    half = n // 2
    if n == 3:
        return np.array([math.sqrt(0.5)])
    m = norm_ppf((np.arange(1, half + 1) - 0.375) / (n + 0.25))  # negative values
    summ2 = 2.0 * float(np.sum(m * m))
    ssumm2 = math.sqrt(summ2)
    rsn = 1.0 / math.sqrt(n)
    a = np.empty(half)
    a1 = _poly(_C1, rsn) - m[0] / ssumm2
    if n > 5:
        a2 = -m[1] / ssumm2 + _poly(_C2, rsn)
        fac = math.sqrt((summ2 - 2.0 * m[0] ** 2 - 2.0 * m[1] ** 2) / (1.0 - 2.0 * a1 ** 2 - 2.0 * a2 ** 2))
        a[1] = a2
        first = 2
    else:
        fac = math.sqrt((summ2 - 2.0 * m[0] ** 2) / (1.0 - 2.0 * a1 ** 2))
        first = 1
    a[0] = a1
    a[first:] = -m[first:] / fac
    return a


def shapiro(x) -> tuple[float, float]:
    """Shapiro-Wilk (W, p) for 3 <= n <= 5000."""
    x = np.sort(np.asarray(x, dtype=float))
    n = x.size
    if n < 3:
        raise ValueError("Data must be at least length 3.")
    if x[-1] - x[0] == 0.0:
        return 1.0, 1.0
    half = shapiro_coefficients(n)
    weights = np.zeros(n)
    weights[:n // 2] = -half
    weights[n - n // 2:] = half[::-1]
    xc = x - x.mean()
    w = float(np.dot(weights, x) ** 2 / (np.dot(weights, weights) * np.dot(xc, xc)))
    w = min(w, 1.0)
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    """Royston's p-value of a Shapiro-Wilk statistic ``w`` of ``n`` values."""
    if n == 3:
        return max(1.90985931710274 * (math.asin(math.sqrt(max(w, 0.75))) - 1.04719755119660), 0.0)
    y = math.log1p(-w) if w < 1.0 else -math.inf
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return 1e-19
        y = -math.log(gamma - y)
        mu, sd = _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        ln = math.log(n)
        mu, sd = _poly(_C5, ln), math.exp(_poly(_C6, ln))
    if y == -math.inf:
        return 1.0
    return float(norm_sf((y - mu) / sd))


# Stephens' normal-case critical points and their levels (%).
ANDERSON_NORMAL_POINTS = (0.576, 0.656, 0.787, 0.918, 1.092)
ANDERSON_NORMAL_LEVELS = (15.0, 10.0, 5.0, 2.5, 1.0)


def anderson_normal(x, points=ANDERSON_NORMAL_POINTS) -> tuple[float, list[float]]:
    """Anderson-Darling A^2 for normality (estimated mean and sample sd) and critical values."""
    y = np.sort(np.asarray(x, dtype=float))
    n = y.size
    s = y.std(ddof=1)
    z = (y - y.mean()) / s
    logcdf = np.log(norm_cdf(z))
    logsf = np.log(norm_sf(z))
    i = np.arange(1, n + 1)
    a2 = -n - float(np.sum((2 * i - 1.0) / n * (logcdf + logsf[::-1])))
    crit = [float(np.around(p / (1.0 + 4.0 / n - 25.0 / n / n), 3)) for p in points]
    return a2, crit


def probplot(x) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Normal probability plot: (theoretical quantiles, ordered values, slope, intercept, r)."""
    osr = np.sort(np.asarray(x, dtype=float))
    n = osr.size
    if n < 2:  # no line through one point
        return np.zeros(n), osr, math.nan, math.nan, math.nan
    u = np.empty(n)
    u[-1] = 0.5 ** (1.0 / n)
    u[0] = 1.0 - u[-1]
    u[1:-1] = (np.arange(2, n) - 0.3175) / (n + 0.365)
    osm = norm_ppf(u)
    xm, ym = osm.mean(), osr.mean()
    sxx = float(np.sum((osm - xm) ** 2))
    sxy = float(np.sum((osm - xm) * (osr - ym)))
    syy = float(np.sum((osr - ym) ** 2))
    slope = sxy / sxx
    intercept = ym - slope * xm
    r = sxy / math.sqrt(sxx * syy) if syy > 0 else 0.0
    return osm, osr, slope, intercept, r


# ------------------------------------------------------------------------ DTW
def _dtw(x: np.ndarray, y: np.ndarray, first=None, last=None):
    """DTW with |x_i - y_j| cost over the columns ``first[i]..last[i]`` of each row (None: all).

    Two rows of costs are held, and one byte a cell for the way back.
    """
    n, m = x.size, y.size
    if n == 0 or m == 0:
        return (0.0 if n == m else math.inf), []
    if first is None:
        first, last = np.zeros(n, dtype=np.int64), np.full(n, m - 1, dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(last - first + 1)]).tolist()
    move = bytearray(start[-1])
    first, last = first.tolist(), last.tolist()
    inf = math.inf
    above, above_first = [0.0], -1  # the corner before the first cell
    for i in range(n):
        lo, hi, at = first[i], last[i], start[i]
        gap = np.abs(x[i] - y[lo:hi + 1]).tolist()
        row, left, known = [], inf, len(above)
        for k, d in enumerate(gap):
            u = lo + k - above_first
            best, step = (above[u] if 0 <= u < known else inf), 0
            if left < best:
                best, step = left, 1
            diag = above[u - 1] if 0 < u <= known else inf
            if diag < best:
                best, step = diag, 2
            left = best + d
            row.append(left)
            move[at + k] = step
        above, above_first = row, lo
    path = []
    i, j = n - 1, m - 1
    while i >= 0 and j >= 0:
        path.append((i, j))
        step = move[start[i] + j - first[i]]
        if step != 1:
            i -= 1
        if step != 0:
            j -= 1
    path.reverse()
    return float(above[-1]), path


def _coarsen(x: np.ndarray) -> np.ndarray:
    k = x.size // 2
    return (x[: 2 * k: 2] + x[1: 2 * k: 2]) / 2.0


def _project(path, n: int, m: int, radius: int):
    """Per fine row the columns within ``radius`` coarse cells of the coarse path.

    The path is connected and never turns back, so they are one interval.
    """
    steps = np.array(path)
    rows = int(steps[-1, 0]) + 1
    low = steps[np.searchsorted(steps[:, 0], np.arange(rows)), 1]
    high = steps[np.searchsorted(steps[:, 0], np.arange(rows), side="right") - 1, 1]
    coarse = np.minimum(np.arange(n) // 2, rows - 1 + radius)
    first = 2 * (low[np.clip(coarse - radius, 0, rows - 1)] - radius)
    last = 2 * (high[np.clip(coarse + radius, 0, rows - 1)] + radius) + 1
    first, last = np.clip(first, 0, m - 1), np.clip(last, 0, m - 1)
    last[-1] = m - 1
    return first, last


def fastdtw(x, y, radius: int = 1):
    """Approximate DTW (distance, path) by coarsening, projecting and refining."""
    x = np.asarray(x, dtype=float).ravel()
    y = np.asarray(y, dtype=float).ravel()
    if x.size < radius + 2 or y.size < radius + 2:
        return _dtw(x, y)
    _, coarse = fastdtw(_coarsen(x), _coarsen(y), radius)
    return _dtw(x, y, *_project(coarse, x.size, y.size, radius))


def dtw_exact(x, y):
    x = np.asarray(x, dtype=float).ravel()
    y = np.asarray(y, dtype=float).ravel()
    return _dtw(x, y)


def minmax(v) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    span = v.max() - v.min()
    return (v - v.min()) / span if span > 0 else v - v.min()


def zscore(v) -> np.ndarray:
    v = np.asarray(v, dtype=float)
    sd = v.std()
    return (v - v.mean()) / sd if sd > 0 else v - v.mean()
