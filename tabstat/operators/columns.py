"""Column and row operators of the cleaning and modelling steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import MISSING_LABEL

NEAR_ZERO = 1e-8
SCHEMA_LABELS = ("Observaciones", "Variables", "Numéricas", "Categóricas")  # fixed values


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def variances(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Population variance per column, one pass over a long form."""
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("double").alias("x")) for c in cols])
    rows = df.select(F.explode(pairs).alias("p")).groupBy("p.c").agg(F.var_pop("p.x").alias("v")).collect()
    return {r["c"]: r["v"] for r in rows}


def near_constant_filter(df: DataFrame, cols: list[str], tol: float = NEAR_ZERO) -> tuple[DataFrame, list[tuple]]:
    """(table without the listed columns whose variance is at most ``tol`` or
    missing, rows (column, variance, kept))."""
    var = variances(df, cols)
    rows = [(c, var.get(c), var.get(c) is not None and var[c] > tol) for c in cols]
    return df.drop(*[c for c, _, kept in rows if not kept]), rows


def zero_variance_drop(df: DataFrame, cols: list[str], tol: float = NEAR_ZERO) -> tuple[DataFrame, list[tuple]]:
    """(table without the listed columns of variance zero, rows (column,
    variance, dropped)); a column without values stays."""
    var = variances(df, cols)
    rows = [(c, var.get(c), var.get(c) is not None and abs(var[c]) <= tol) for c in cols]
    return df.drop(*[c for c, _, gone in rows if gone]), rows


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing, NaN and infinite values become the mean of the others."""
    x = {c: q(c).cast("double") for c in cols}
    clean = {c: F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v) for c, v in x.items()}
    means = df.agg(*[F.avg(v).alias(c) for c, v in clean.items()]).first()
    return df.withColumns({c: F.coalesce(v, F.lit(means[c])) for c, v in clean.items()})


def drop_missing_rows(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Rows with a target and, if given, with all the features."""
    return df.dropna(subset=[target, *(features or [])])


def fill_label(c: str, label: str = MISSING_LABEL) -> Column:
    return F.coalesce(q(c), F.lit(label))


def schema_profile(df: DataFrame) -> list[tuple[str, int]]:
    """Rows, columns, numeric and other columns, under their labels."""
    numeric = sum(isinstance(f.dataType, NumericType) for f in df.schema.fields)
    return list(zip(SCHEMA_LABELS, (df.count(), len(df.columns), numeric, len(df.columns) - numeric)))


def label_encode_binary(c: str, positive: str) -> Column:
    return F.when(q(c) == F.lit(positive), 1).otherwise(0)


def present(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, n_present) of the columns, one pass."""
    names = F.array(*[F.struct(F.lit(c).alias("variable"), q(c).isNotNull().alias("there")) for c in cols])
    return df.select(F.explode(names).alias("p")).groupBy("p.variable").agg(F.count_if("p.there").alias("n_present"))
