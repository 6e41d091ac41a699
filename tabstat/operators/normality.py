"""Normality tests as Spark jobs.

* Shapiro-Wilk W with Royston's (1992, 1995) approximation: ranks from the
  bucketed global row number, normal scores by a column expression, the
  weights as a column expression, W = corr(a, x)^2 in one aggregate.
* Kolmogorov-Smirnov against N(0, 1) after standardising: the statistic is
  evaluated at distinct values only (running counts, bucketed).
* D'Agostino-Pearson K^2 from one moments aggregate.
* QQ points with Filliben's plotting positions and the fitted line.

Only scalars reach the driver; the p-values use ``functions.special``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf_col, norm_sf, with_norm_ppf
from ..functions.special import chi2_sf, kolmogorov_sf
from ..session import materialize
from .rank import expand_positions, global_row_number, value_counts_ranked

# Royston's polynomial coefficients (lowest power first).
SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]

SHAPIRO_MAX_N = 5000


def _poly(c: list[float], x: float) -> float:
    return sum(ci * x**i for i, ci in enumerate(c))


@dataclass(frozen=True)
class TestResult:
    test: str
    variable: str
    statistic: float | None
    p_value: float | None
    n: int

    @property
    def rejected(self) -> bool | None:
        return None if self.p_value is None else bool(self.p_value <= 0.05)

    def as_row(self):
        return (self.test, self.variable, self.statistic, self.p_value, self.n, self.rejected)


RESULT_SCHEMA = "test string, variable string, statistic double, p_value double, n long, rejected boolean"


def _values(df: DataFrame, column: str, key: str | None) -> DataFrame:
    cols = [F.col(f"`{column}`").cast("double").alias("x")]
    if key:
        cols.append(F.col(f"`{key}`").alias("__k"))
    return df.select(*cols).where(F.col("x").isNotNull() & ~F.isnan("x"))


def shapiro_wilk(df: DataFrame, column: str, key: str | None = None) -> TestResult:
    """W and p (Royston). Valid approximation up to n = 5000; computed (not
    capped) beyond, like common implementations."""
    vals = _values(df, column, key)
    n = vals.count()
    if n < 3:
        return TestResult("Shapiro-Wilk", column, None, None, n)
    ranked = global_row_number(vals, "x", tiebreak=["__k"] if key else None, name="i")
    ranked = ranked.withColumn("pp", (F.col("i") - 0.375) / F.lit(n + 0.25))
    ranked = with_norm_ppf(ranked, "pp", "m")
    if n == 3:
        a = (F.col("i") - 2).cast("double") * F.lit(math.sqrt(0.5))
    else:
        st = ranked.agg(F.sum(F.col("m") * F.col("m")).alias("s2"), F.min("m").alias("m1"),
                        F.min(F.when(F.col("i") == 2, F.col("m"))).alias("m2")).collect()[0]
        summ2, m1, m2 = st["s2"], st["m1"], st["m2"]
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(SW_C1, rsn) - m1 / ssumm2
        if n > 5:
            a2 = _poly(SW_C2, rsn) - m2 / ssumm2
            fac = math.sqrt((summ2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
            a = (F.when(F.col("i") == n, a1).when(F.col("i") == 1, -a1)
                 .when(F.col("i") == n - 1, a2).when(F.col("i") == 2, -a2)
                 .otherwise(F.col("m") / F.lit(fac)))
        else:
            fac = math.sqrt((summ2 - 2 * m1 * m1) / (1 - 2 * a1 * a1))
            a = F.when(F.col("i") == n, a1).when(F.col("i") == 1, -a1).otherwise(F.col("m") / F.lit(fac))
    r = ranked.select(a.alias("a"), "x").agg(F.corr("a", "x").alias("r")).collect()[0]["r"]
    if r is None:
        return TestResult("Shapiro-Wilk", column, None, None, n)
    w = min(1.0, r * r)
    return TestResult("Shapiro-Wilk", column, w, shapiro_p(w, n), n)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 1.90985931710274 * (math.asin(math.sqrt(w)) - 1.04719755119660))
    w1 = 1.0 - w
    if w1 <= 0:
        return 1.0
    y = math.log(w1)
    if n <= 11:
        gamma = _poly(SW_G, n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        m, s = _poly(SW_C3, n), math.exp(_poly(SW_C4, n))
    else:
        xx = math.log(n)
        m, s = _poly(SW_C5, xx), math.exp(_poly(SW_C6, xx))
    return norm_sf((y - m) / s)


def ks_statistic(df: DataFrame, column: str, ddof: int = 0) -> TestResult:
    """One-sample KS of the standardised column against N(0, 1).
    ``ddof=0``: population std (profile step); ``ddof=1``: sample std
    (residual fallback)."""
    vals = _values(df, column, None)
    st = vals.agg(F.count("x").alias("n"), F.avg("x").alias("mu"),
                  (F.stddev_pop("x") if ddof == 0 else F.stddev_samp("x")).alias("sd")).collect()[0]
    n, mu, sd = st["n"], st["mu"], st["sd"]
    if not n or sd is None or sd == 0:
        return TestResult("Kolmogorov-Smirnov", column, None, None, n or 0)
    ranked = value_counts_ranked(vals, "x")
    z = ranked.withColumn("z", (F.col("value") - F.lit(mu)) / F.lit(sd)).withColumn("cdf", norm_cdf_col("z"))
    d = z.agg(F.max(F.greatest(F.col("end") / F.lit(float(n)) - F.col("cdf"),
                               F.col("cdf") - F.col("start") / F.lit(float(n)))).alias("d")).collect()[0]["d"]
    return TestResult("Kolmogorov-Smirnov", column, d, kolmogorov_sf(d, n), n)


def dagostino_k2(df: DataFrame, column: str) -> TestResult:
    """D'Agostino-Pearson omnibus K^2 (skewness and kurtosis tests), p from
    chi-square with 2 degrees of freedom."""
    vals = _values(df, column, None)
    st = vals.agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
                  F.var_pop("x").alias("v")).collect()[0]
    n = st["n"]
    if n is None or n < 8 or not st["v"]:
        return TestResult("D'Agostino K²", column, None, None, n or 0)
    k2 = dagostino_from_moments(n, st["g1"], st["g2"] + 3.0)
    return TestResult("D'Agostino K²", column, k2, chi2_sf(k2, 2), n)


def dagostino_from_moments(n: int, b1: float, b2: float) -> float:
    """K^2 from population skewness ``b1`` and kurtosis ``b2`` (not excess)."""
    y = b1 * math.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    y = 1.0 if y == 0 else y
    zs = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))

    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (b2 - e) / math.sqrt(varb2)
    sqrtbeta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sqrtbeta1 * (2.0 / sqrtbeta1 + math.sqrt(1 + 4.0 / (sqrtbeta1**2)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * math.sqrt(2 / (a - 4.0))
    term2 = math.copysign(1.0, denom) * ((1 - 2.0 / a) / abs(denom)) ** (1 / 3.0) if denom != 0 else float("nan")
    zk = (term1 - term2) / math.sqrt(2 / (9.0 * a))
    return zs * zs + zk * zk


def _theoretical(points: DataFrame, n: int) -> DataFrame:
    """(position, theoretical, ordered) from (position, value): Filliben's
    plotting positions through the normal quantile."""
    mn = 0.5 ** (1.0 / n)
    pp = (F.when(F.col("position") == n, F.lit(mn)).when(F.col("position") == 1, F.lit(1.0 - mn))
          .otherwise((F.col("position") - 0.3175) / F.lit(n + 0.365)))
    pts = with_norm_ppf(points.withColumn("pp", pp), "pp", "theoretical")
    return pts.select("position", "theoretical", F.col("value").alias("ordered"))


def _thinned(ranked: DataFrame, n: int, k: int) -> DataFrame:
    """(position, value) of k positions spread evenly over 1..n, from the
    ranked values alone: each value takes the chosen positions that fall into
    its run, so no observation is expanded."""
    m = max(1, k - 1)
    first = F.expr(f"(start * {m}L + {n - 2}L) div {n - 1}L")  # least j whose position is in the run
    last = F.least(F.expr(f"(end * {m}L + {n - 2}L) div {n - 1}L - 1"), F.lit(m))
    runs = ranked.select("value", first.alias("first"), last.alias("last")).where("first <= last")
    chosen = runs.select("value", F.explode(F.sequence("first", "last")).alias("j"))
    return chosen.select(F.expr(f"1 + (j * {n - 1}L) div {m}L").alias("position"), "value")


def qq_points(df: DataFrame, column: str, thin: int | None = None) -> tuple[DataFrame, dict]:
    """(position, theoretical, ordered) and the fitted line {slope, intercept,
    r}. Every observation is a point, repeated values expanded in chunks;
    ``thin=k`` keeps k evenly spread positions (first and last included) of a
    larger column and fits the line to those. Every point left out lies
    between two neighbours that stay, so a line drawn through them is off by
    at most ``largest_step``, the largest rise between neighbours."""
    vals = _values(df, column, None)
    n = vals.count()
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "position long, theoretical double, ordered double"), {}
    ranked = value_counts_ranked(vals, "x")
    short = thin is not None and 1 < thin < n
    pts = _theoretical(_thinned(ranked, n, thin) if short else expand_positions(ranked), n)
    if short:
        pts = materialize(pts, "qq")
    line = pts.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                   F.regr_intercept("ordered", "theoretical").alias("intercept"),
                   F.corr("ordered", "theoretical").alias("r")).collect()[0].asDict()
    if short:
        before = Window.orderBy("position")  # k rows at most
        steps = pts.select((F.col("ordered") - F.lag("ordered").over(before)).alias("step"))
        line["largest_step"] = steps.agg(F.max("step")).first()[0]
    return pts, line


def normality_auto(df: DataFrame, numeric_cols: list[str], preferred: str, test: str = "auto",
                   shapiro_max_n: int = SHAPIRO_MAX_N) -> TestResult | None:
    """Preferred column (speed) if present, else the first numeric column.
    ``test``: shapiro, ks (on the population-standardised data) or auto, which
    takes Shapiro-Wilk up to ``shapiro_max_n`` values, where its approximation
    holds, and KS beyond."""
    if test not in ("auto", "shapiro", "ks"):
        raise ValueError(f"unknown normality test {test}")
    if not numeric_cols:
        return None
    col = preferred if preferred in numeric_cols else numeric_cols[0]
    n = _values(df, col, None).count()
    if n == 0:
        return None
    if test == "shapiro" or (test == "auto" and n <= shapiro_max_n):
        return shapiro_wilk(df, col)
    return ks_statistic(df, col, ddof=0)


def residual_test(df: DataFrame, column: str, n: int, test: str = "auto", shapiro_max_n: int = SHAPIRO_MAX_N) -> TestResult:
    """Normality of ``n`` residuals: ``test`` is shapiro, k2 (D'Agostino) or
    auto, which takes Shapiro-Wilk up to ``shapiro_max_n`` rows and K² beyond;
    KS where the chosen statistic is undefined."""
    if test not in ("auto", "shapiro", "k2"):
        raise ValueError(f"unknown normality test {test}")
    small = test == "shapiro" or (test == "auto" and n <= shapiro_max_n)
    try:
        res = shapiro_wilk(df, column) if small else dagostino_k2(df, column)
        if res.statistic is None:
            raise ValueError("normality statistic undefined")
    except (ArithmeticError, ValueError):  # a numeric failure falls back to KS
        res = ks_statistic(df, column, ddof=1)
    return res


def summary_lines(res: TestResult) -> list[str]:
    """Text of the normality summary (fixed wording, 4 decimals)."""
    verdict = "No se rechaza" if (res.p_value is not None and res.p_value > 0.05) else "Se rechaza"
    return [
        f"Prueba de normalidad: {res.test}",
        f"Variable: {res.variable}",
        f"Estadístico: {res.statistic:.4f}",
        f"p-valor: {res.p_value:.4f}",
        f"n: {res.n}",
        f"Conclusión: {verdict} la normalidad al 5%.",
    ]
