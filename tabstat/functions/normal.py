"""Standard normal CDF and quantile as SQL expressions (Spark and DuckDB
share the syntax used here), plus driver-side scalars.

Spark has no ``erf``. The CDF uses Hart's (1968) double-precision rational
approximation as published by West (2005); the quantile uses Acklam's
rational approximation followed by one Halley step on that CDF.
All constants below are fixed published values.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart (1968) coefficients, numerator then denominator, highest power first.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631

# Acklam's inverse-normal coefficients.
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
ACKLAM_LOW = 0.02425


def _horner(coefs: list[float], x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"(({out}) * {x} + {c!r})"
    return out


def norm_cdf_sql(x: str) -> str:
    """SQL text for Phi(x); ``x`` should be a column name or a short term."""
    a = f"abs({x})"
    tail_inner = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        tail_inner = f"({a} + {k}.0 / {tail_inner})"
    small = f"exp(-{a} * {a} / 2.0) * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)}"
    large = f"exp(-{a} * {a} / 2.0) / {tail_inner} / {SQRT_2PI!r}"
    lower = f"(case when {a} > 37.0 then 0.0 when {a} < {HART_SPLIT!r} then {small} else {large} end)"
    return f"(case when {x} is null then null when {x} > 0 then 1.0 - {lower} else {lower} end)"


def norm_ppf0_sql(p: str) -> str:
    """SQL text for Acklam's first approximation of Phi^-1(p), 0 < p < 1."""
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    low = f"{_horner(ACKLAM_C, ql)} / ({_horner(ACKLAM_D + [1.0], ql)})"
    high = f"-{_horner(ACKLAM_C, qh)} / ({_horner(ACKLAM_D + [1.0], qh)})"
    qc = f"({p} - 0.5)"
    r = f"({qc} * {qc})"
    mid = f"{_horner(ACKLAM_A, r)} * {qc} / ({_horner(ACKLAM_B + [1.0], r)})"
    return (f"(case when {p} is null or {p} <= 0.0 or {p} >= 1.0 then null "
            f"when {p} < {ACKLAM_LOW!r} then {low} when {p} > {1 - ACKLAM_LOW!r} then {high} else {mid} end)")


def halley_sql(x0: str, p: str) -> str:
    """One Halley step refining x0 towards Phi^-1(p) (x0 and p are column names)."""
    e = f"({norm_cdf_sql(x0)} - {p})"
    u = f"({e} * {math.sqrt(2 * math.pi)!r} * exp({x0} * {x0} / 2.0))"
    return f"({x0} - {u} / (1.0 + {x0} * {u} / 2.0))"


def with_norm_ppf(df: DataFrame, p_col: str, out_col: str) -> DataFrame:
    """Add Phi^-1(p) as a column (two projection steps, JVM side)."""
    tmp = f"__{out_col}_x0"
    df = df.withColumn(tmp, F.expr(norm_ppf0_sql(f"`{p_col}`")))
    return df.withColumn(out_col, F.expr(halley_sql(f"`{tmp}`", f"`{p_col}`"))).drop(tmp)


def norm_cdf_col(x: str) -> Column:
    return F.expr(norm_cdf_sql(f"`{x}`"))


# driver-side scalars (exact to double precision)
_STD = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _STD.inv_cdf(p)
