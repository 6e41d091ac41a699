"""p-values on the driver without SciPy: regularized incomplete beta and
gamma functions (continued fractions, modified Lentz), and the Kolmogorov
limit distribution. Inputs are a handful of scalars per test."""

from __future__ import annotations

import math

EPS = 1e-15
TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > TINY else TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > TINY else TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, delta = a, 1.0 / a, 1.0 / a
        for _ in range(100_000):
            ap += 1.0
            delta *= x / ap
            s += delta
            if abs(delta) < abs(s) * EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < EPS:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


# degrees of freedom from which Student's t is the normal law and F the
# chi-square law to more digits than the continued fraction keeps
NORMAL_FROM = 1e8


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > NORMAL_FROM:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    if d2 > NORMAL_FROM:
        return chi2_sf(d1 * f, d1)
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-square with k degrees of freedom."""
    if x is None or math.isnan(x):
        return float("nan")
    return gammaincc(k / 2.0, x / 2.0)


def kolmogorov_sf(d: float, n: int) -> float:
    """Two-sided one-sample KS p-value: Kolmogorov limit law with Stephens'
    small-sample correction."""
    if n <= 0 or d is None:
        return float("nan")
    sn = math.sqrt(n)
    lam = (sn + 0.12 + 0.11 / sn) * d
    if lam < 1e-3:
        return 1.0
    if lam < 1.18:
        # small-lambda form of the same series (fast convergence there)
        c = math.sqrt(2.0 * math.pi) / lam
        t = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8.0 * lam * lam)) for k in range(1, 21))
        return min(1.0, max(0.0, 1.0 - c * t))
    s = 0.0
    for k in range(1, 200):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, s))
