"""Presentation helpers for result tables (rounding before comparison)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def round_doubles(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (sums differ in the last bits between
    engines; results are compared at a fixed number of decimals)."""
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skip:
            out.append(F.round(F.col(name), digits).alias(f.name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def round_columns(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Round the listed columns that are present and numeric."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    out = []
    for c in df.columns:
        if c in columns and c in numeric:
            out.append(F.round(F.col(f"`{c}`"), columns[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)
