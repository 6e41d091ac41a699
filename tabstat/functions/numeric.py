"""Numeric column expressions: clipping, labels, moments, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..config import HIGH_CONGESTION_LABEL, HIGH_CONGESTION_SPEED, NORMAL_LABEL


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(df: DataFrame, c: str) -> Column:
    """The column's value, null where it is missing: NaN is as missing as
    null, for every statistic."""
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else col


def log1p_clip(c) -> Column:
    """log1p of the value clipped at 0; NULL stays NULL
    (``greatest(NULL, 0)`` would be 0, hence the guard)."""
    col = _col(c)
    return F.when(col.isNotNull(), F.log1p(F.greatest(col, F.lit(0.0))))


def clip(c, lower: float | None, upper: float | None) -> Column:
    col = _col(c)
    out = col
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(lower)).otherwise(out)
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(upper)).otherwise(out)
    return F.when(col.isNotNull(), out)


def threshold_label(c, threshold: float = HIGH_CONGESTION_SPEED) -> Column:
    """Below the threshold: high congestion; otherwise, missing included: normal."""
    return F.when(_col(c) < F.lit(threshold), F.lit(HIGH_CONGESTION_LABEL)).otherwise(F.lit(NORMAL_LABEL))


def sample_skew(c) -> Column:
    """Bias-corrected skewness G1 (pandas/DuckDB rule): NULL for n < 3, 0 for
    a constant column; NaN is missing."""
    col = _col(c).cast("double")
    col = F.when(~F.isnan(col), col)
    n = F.count(col).cast("double")
    g1 = F.skewness(col)
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.var_pop(col) == 0, F.lit(0.0)).otherwise(adj)


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2: NULL for n < 4, 0 for a constant
    column; NaN is missing."""
    col = _col(c).cast("double")
    col = F.when(~F.isnan(col), col)
    n = F.count(col).cast("double")
    g2 = F.kurtosis(col)  # population excess kurtosis
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.var_pop(col) == 0, F.lit(0.0)).otherwise(adj)


def round_half_up(c, digits: int = 2) -> Column:
    return F.round(_col(c), digits)
