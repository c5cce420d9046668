"""DuckDB forms of the normal distribution, the normality tests and correlation p-values.

Written apart from the library's kernels: the distribution function is its
power series, quantiles are Newton steps on it, weights are set row by row
and Student's t is a finite sum.
"""

from __future__ import annotations


def normal_cdf(x: str) -> str:
    """Series x + x^3/3 + x^5/15 + ... times the density, from one half."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + lgamma(0.5))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum([{term} for k in range(0, 150)]))"


def quantile_ctes(src: str, u: str, name: str) -> str:
    """CTEs ``name0`` to ``name6``: the rows of ``src`` with ``u`` and its normal quantile ``x`` (in ``name6``)."""
    steps = [f"{name}0 AS (SELECT *, {u} AS u, 4.91 * (pow({u}, 0.14) - pow(1 - ({u}), 0.14)) AS x FROM {src})"]
    for k in range(6):
        better = f"x - ({normal_cdf('x')} - u) * sqrt(2 * pi()) * exp(x * x / 2)"
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT * REPLACE ({better} AS x) FROM {name}{k})")
    return ",\n".join(steps)


def long_ctes(src: str, cols, g: str) -> str:
    """CTE ``ranked``: one row for each value of ``cols`` with its place and its series' size, mean and deviation."""
    union = " UNION ALL ".join(f"SELECT {g}, '{c}' AS variable, {c} AS v FROM {src}" for c in cols)
    return f"""long AS ({union}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {g}, variable ORDER BY v) AS i, count(*) OVER a AS n,
                  avg(v) OVER a AS mu, stddev_samp(v) OVER a AS sd, min(v) OVER a AS lo, max(v) OVER a AS hi
           FROM long WHERE v IS NOT NULL WINDOW a AS (PARTITION BY {g}, variable))"""


def _poly(coefficients, x: str) -> str:
    return "(" + " + ".join(f"({c}) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def normality_ctes(src: str, cols, g: str = "project") -> str:
    """CTE ``normality``: n, w, p, a2, lo and hi of each series of ``src`` with at least three values that vary."""
    # The coefficients of Royston's algorithm.
    c1 = _poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], "rsn")
    c2 = _poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], "rsn")
    small_mu, small_sd = _poly([0.5440, -0.39978, 0.025054, -6.714e-4], "n"), _poly([1.3822, -0.77857, 0.062767, -0.0020322], "n")
    mu, sd = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], "ln(n)"), _poly([-0.4803, -0.082676, 0.0030302], "ln(n)")
    gamma = "(-2.273 + 0.459 * n)"
    z_small = f"((-ln({gamma} - ln(1 - w)) - {small_mu}) / exp({small_sd}))"
    z_large = f"((ln(1 - w) - {mu}) / exp({sd}))"
    below, above = normal_cdf("((v - mu) / sd)"), normal_cdf("((mu - v) / sd)")
    return f"""{long_ctes(src, cols, g)},
{quantile_ctes("ranked", "((i - 0.375) / (n + 0.25))", "score")},
scored AS (SELECT *, 1 / sqrt(n) AS rsn, sum(x * x) OVER a AS mm, max(x) OVER a AS top,
                  max(CASE WHEN i = n - 1 THEN x END) OVER a AS second_top
           FROM score6 WHERE n >= 3 AND hi > lo WINDOW a AS (PARTITION BY {g}, variable)),
outer_weights AS (SELECT *, {c1} + top / sqrt(mm) AS a1, {c2} + second_top / sqrt(mm) AS a2 FROM scored),
weighted AS (SELECT *, CASE WHEN n = 3 THEN (i - 2) * sqrt(0.5) WHEN i = n THEN a1 WHEN i = 1 THEN -a1
                            WHEN n > 5 AND i = n - 1 THEN a2 WHEN n > 5 AND i = 2 THEN -a2
                            WHEN n > 5 THEN x / sqrt((mm - 2 * top * top - 2 * second_top * second_top) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
                            ELSE x / sqrt((mm - 2 * top * top) / (1 - 2 * a1 * a1)) END AS weight FROM outer_weights),
tested AS (SELECT {g}, variable, any_value(n) AS n, pow(sum(weight * v), 2) / (sum(weight * weight) * sum(pow(v - mu, 2))) AS w,
                  -any_value(n) - sum((2 * i - 1) * ln({below}) + (2 * (n - i) + 1) * ln({above})) / any_value(n) AS a2
           FROM weighted GROUP BY {g}, variable),
varied AS (SELECT *, CASE WHEN n = 3 THEN greatest(1.90985931710274 * (asin(sqrt(greatest(least(w, 1.0), 0.75))) - 1.04719755119660), 0)
                          WHEN w >= 1 THEN 1.0 WHEN n <= 11 AND ln(1 - w) >= {gamma} THEN 1e-19
                          WHEN n <= 11 THEN 1 - {normal_cdf(z_small)} ELSE 1 - {normal_cdf(z_large)} END AS p FROM tested),
normality AS (SELECT {g}, variable, s.n, CASE WHEN s.n >= 3 THEN coalesce(least(w, 1.0), 1.0) END AS w,
                     CASE WHEN s.n >= 3 THEN coalesce(p, 1.0) END AS p, a2,
                     CASE WHEN s.n >= 3 THEN coalesce(p, 1.0) > 0.05 END AS is_normal
              FROM (SELECT {g}, variable, count(*) AS n FROM ranked GROUP BY {g}, variable) s
              LEFT JOIN varied USING ({g}, variable))"""


def correlation_p(r: str, n: str) -> str:
    """Two-sided p of a correlation of ``n`` pairs: Student's t with n - 2 degrees of freedom as a finite sum."""
    rest = f"ln(1 - {r} * {r})"
    even = f"list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5) + j * {rest}) for j in range(0, ({n} - 2) // 2)])"
    odd = f"list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + (j + 0.5) * {rest}) for j in range(0, ({n} - 3) // 2)])"
    return f"""(CASE WHEN {r} IS NULL OR {n} < 2 THEN NULL WHEN {n} = 2 THEN 1.0 WHEN abs({r}) >= 1 THEN 0.0
      WHEN {n} % 2 = 0 THEN 1 - abs({r}) * {even}
      ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * coalesce({odd}, 0)) END)"""
