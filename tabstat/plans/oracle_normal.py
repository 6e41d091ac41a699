"""The normal distribution in DuckDB SQL for the oracles, by other means than
the library's: the CDF from its power series about 0, the quantile by Newton
steps on the logarithm of the CDF."""

from __future__ import annotations

TERMS = 140  # of the series; enough for |z| <= 9
NEWTON = 9

# Royston's polynomial coefficients (lowest power first) for the
# last two weights and for the mean and spread of ln(1 - W), n > 11.
WEIGHT_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
WEIGHT_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
MEAN_LN = [-1.5861, -0.31082, -0.083751, 0.0038915]
SPREAD_LN = [-0.4803, -0.082676, 0.0030302]


def cdf(z: str) -> str:
    """P(N <= z): 1/2 + pdf(z) (z + z^3/3 + z^5/(3 5) + ...), odd in z."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())) - {z} * {z} / 2)"
    series = f"list_sum(list_transform(range(0, {TERMS}), lambda k: {term})) / sqrt(2 * pi())"
    return (f"(case when {z} is null then null when {z} = 0 then 0.5 when abs({z}) > 9 then (case when {z} > 0 then 1.0 else 0.0 end) "
            f"else 0.5 + sign({z}) * {series} end)")


def quantile_ctes(name: str, source: str, p: str) -> str:
    """CTEs up to {name}: the rows of ``source`` with ``x``, the quantile of
    their column ``p`` (0 < p < 1). Of p and 1 - p the smaller one is solved
    for, from the left, where the steps rise towards the solution."""
    out = f"""{name}_0 AS (select *, least({p}, 1 - {p}) as tail, ln(least({p}, 1 - {p}) / (1 - least({p}, 1 - {p}))) / 1.702 as t from {source})"""
    for i in range(1, NEWTON + 1):
        out += f""",
{name}_{i} AS (select * exclude (c) replace (t - (ln(c) - ln(tail)) * c / (exp(-t * t / 2) / sqrt(2 * pi())) as t) from (select *, greatest({cdf('t')}, 1e-300) as c from {name}_{i - 1}))"""
    return out + f""",
{name} AS (select * exclude (t, tail), case when {p} < 0.5 then t when {p} > 0.5 then -t else 0.0 end as x from {name}_{NEWTON})"""
