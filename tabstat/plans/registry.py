"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the ``raw_obs`` fixture or a
driver table directly), so its work grows with the data. Double columns are
rounded for the engine-to-engine comparison; the operators themselves
return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PrepareOptions, Roles
from ..functions.present import round_doubles
from ..operators import profile as prof
from ..session import compiled_rows
from ..session import materialize as write_once
from ..sources.fixtures import content_key, raw_obs
from .prepare import derived, finish, prepare

ROLES = Roles()


_DERIVED: dict[tuple, DataFrame] = {}
_PREPARED: dict[tuple, tuple[DataFrame, object]] = {}


def prepared(spark: SparkSession, sf_dir: str, options: PrepareOptions = PrepareOptions()):
    """``prepare`` of the fixture; the derived rows are written once per
    application and input to the shared checkpoint folder, whatever the length
    transform. Returns (DataFrame, PrepareReport)."""
    key = content_key(spark, sf_dir)
    if (key, options) not in _PREPARED:
        rows = (key, options.sum_duration_parts)
        if rows not in _DERIVED:
            raw = raw_obs(spark, sf_dir)
            with compiled_rows(spark):
                _DERIVED[rows] = write_once(derived(raw, ROLES, options), "derived")
        _PREPARED[key, options] = finish(_DERIVED[rows], ROLES, options)
    return _PREPARED[key, options]


def obs(spark: SparkSession, sf_dir: str, options: PrepareOptions = PrepareOptions()) -> DataFrame:
    return prepared(spark, sf_dir, options)[0]


def q_prepare(spark, sf_dir):
    df, _ = prepare(raw_obs(spark, sf_dir), ROLES)
    df = df.withColumn("dt_start", F.col("dt_start").cast("string")).withColumn("dt_end", F.col("dt_end").cast("string"))
    df = df.withColumn("duration_min", F.round("duration_min", 6))
    for c in ("hour_sin", "hour_cos", "length_log1p"):
        df = df.withColumn(c, F.round(c, 9))
    return df


def q_group_summary(spark, sf_dir):
    return prof.group_summary(obs(spark, sf_dir), ROLES)


def numeric_cols(df: DataFrame) -> list[str]:
    return prof.present(df, ROLES.numeric_order())


def categorical_cols(df: DataFrame) -> list[str]:
    return prof.present(df, ROLES.categorical())


def q_numeric_summary(spark, sf_dir):
    df = obs(spark, sf_dir)
    return prof.numeric_summary(df, numeric_cols(df))


def q_column_skew(spark, sf_dir):
    from ..functions.numeric import sample_skew

    df = obs(spark, sf_dir)
    return df.agg(F.round(sample_skew(ROLES.length_num), 6).alias("skew"))


def q_categorical_profile(spark, sf_dir):
    df = obs(spark, sf_dir)
    return prof.categorical_profile(df, categorical_cols(df))


def q_missing_report(spark, sf_dir):
    return prof.missing_report(obs(spark, sf_dir))


def q_columns_with_missing(spark, sf_dir):
    return prof.missing_report(obs(spark, sf_dir)).where("n_missing > 0").select("variable", "n_missing")


def q_missing_sorted(spark, sf_dir):
    return prof.missing_report(obs(spark, sf_dir)).orderBy(F.desc("pct_missing"), "pos")


def q_group_mean(spark, sf_dir):
    return prof.group_mean(obs(spark, sf_dir), ROLES.peak, ROLES.speed_num, "speed_mean")


def q_group_argmin(spark, sf_dir):
    return prof.group_argmin(prof.group_summary(obs(spark, sf_dir), ROLES), ROLES.district, "speed_mean")


def q_category_counts_topk(spark, sf_dir):
    df = obs(spark, sf_dir)
    parts = [prof.category_counts(df, c, top_k=20) for c in categorical_cols(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_category_shares(spark, sf_dir):
    return round_doubles(prof.category_shares(obs(spark, sf_dir), ROLES.district), 9)


def q_correlation_matrix(spark, sf_dir):
    df = obs(spark, sf_dir)
    return prof.correlation_long(df, numeric_cols(df), digits=6)


def q_correlation_pairs(spark, sf_dir):
    df = obs(spark, sf_dir)
    cols = numeric_cols(df)
    return prof.correlation_pairs(prof.correlation_long(df, cols, digits=6), cols)


def q_top_correlations(spark, sf_dir):
    return q_correlation_pairs(spark, sf_dir).limit(5)


def q_histogram_bins(spark, sf_dir):
    df = obs(spark, sf_dir)
    return round_doubles(prof.histogram_bins(df, numeric_cols(df)), 6)


def q_boxplot_stats(spark, sf_dir):
    df = obs(spark, sf_dir)
    return round_doubles(prof.boxplot_stats(df, numeric_cols(df)), 6)


def q_density_grid(spark, sf_dir):
    return round_doubles(prof.density_grid(obs(spark, sf_dir), ROLES.speed_num), 9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "prepare": q_prepare,
    "group_summary": q_group_summary,
    "numeric_summary": q_numeric_summary,
    "column_skew": q_column_skew,
    "categorical_profile": q_categorical_profile,
    "missing_report": q_missing_report,
    "columns_with_missing": q_columns_with_missing,
    "missing_sorted": q_missing_sorted,
    "group_mean": q_group_mean,
    "group_argmin": q_group_argmin,
    "category_counts_topk": q_category_counts_topk,
    "category_shares": q_category_shares,
    "correlation_matrix": q_correlation_matrix,
    "correlation_pairs": q_correlation_pairs,
    "top_correlations": q_top_correlations,
    "histogram_bins": q_histogram_bins,
    "boxplot_stats": q_boxplot_stats,
    "density_grid": q_density_grid,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import q_flow, q_model, q_rows

    out = dict(QUERIES)
    out.update(q_rows.QUERIES)
    out.update(q_model.QUERIES)
    out.update(q_flow.QUERIES)
    return out
