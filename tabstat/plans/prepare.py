"""``prepare``: dirty text observations to one typed, enriched table.

All steps are projections over the scan; two small aggregates decide the
data-dependent parts (winsor bounds when asked for, and one pass for the
length skewness plus the constant-column check over every column).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PrepareOptions, Roles
from ..functions.duration import fill_duration_minutes, with_duration
from ..functions.numeric import clip, log1p_clip, sample_skew, threshold_label
from ..functions.text import known_text, plain_number, strip_ws
from ..functions.time import (
    circular_midpoint,
    cyclic_encode,
    hour_fraction,
    midnight_rollover,
    peak_flag,
    seconds_between,
    with_datetimes,
)
from ..operators.quantile import exact_quantiles


@dataclass(frozen=True)
class PrepareReport:
    """Facts decided while cleaning (the reference wrote them into its config)."""

    length_feature: str
    length_transform: str  # missing | none | log1p | winsor
    length_skewness: float | None
    length_raw_excluded: bool
    constant_columns: list[str] = field(default_factory=list)
    winsor_bounds: tuple[float, float] | None = None


def derive(raw: DataFrame, roles: Roles = Roles(), options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Row-level part of ``prepare`` (no aggregate): cleaning, typing, times,
    durations, peak, cyclic hour and label. Works on streaming frames too."""
    cols = set(raw.columns)
    numeric_map = dict(roles.numeric_text())
    text_cols = set(roles.text_columns())
    # stripped once, in a projection of its own: every later use reads that
    df = raw.select(*[strip_ws(F.col(f"`{c}`").cast("string")).alias(c) if c in text_cols | set(numeric_map) else F.col(f"`{c}`") for c in raw.columns])
    out = []
    for c in raw.columns:
        col = F.col(f"`{c}`")
        if c in text_cols:
            out.append(known_text(col).alias(c))
        elif c in numeric_map:
            out.append(plain_number(col).alias(numeric_map[c]))
        else:
            out.append(col)
    df = df.select(*out)

    if {roles.day, roles.start, roles.end} <= cols:
        base = [F.col(f"`{c}`") for c in df.columns]
        df = with_datetimes(df, {roles.dt_start: (roles.day, roles.start), "__end_raw": (roles.day, roles.end)})
        df = df.select(*base, F.col(roles.dt_start),
                       midnight_rollover(F.col(roles.dt_start), F.col("__end_raw")).alias(roles.dt_end))
    else:
        df = df.select("*", F.lit(None).cast("timestamp_ntz").alias(roles.dt_start),
                       F.lit(None).cast("timestamp_ntz").alias(roles.dt_end))
    ts0, ts1 = F.col(roles.dt_start), F.col(roles.dt_end)
    out_cols = [F.col(f"`{c}`") for c in df.columns]

    if roles.duration_text in cols:
        df = with_duration(df, roles.duration_text, "__hours", "__minutes", options.sum_duration_parts)
    else:
        df = df.select("*", F.lit(None).cast("double").alias("__hours"), F.lit(None).cast("double").alias("__minutes"))
    dur = fill_duration_minutes(F.col("__hours"), F.col("__minutes"), seconds_between(ts0, ts1))
    df = df.select(*out_cols, dur.alias(roles.duration_min), hour_fraction(ts0).alias("__hs"), hour_fraction(ts1).alias("__he"))
    out_cols.append(F.col(roles.duration_min))
    df = df.select(*out_cols, "__hs", circular_midpoint(F.col("__hs"), F.col("__he")).alias("__mid"))
    sin, cos = cyclic_encode(F.col("__mid"))
    last = [peak_flag(F.col("__hs")).alias(roles.peak), sin.alias(roles.hour_sin), cos.alias(roles.hour_cos)]
    if roles.speed in cols:
        last.append(threshold_label(roles.speed_num).alias(roles.label))
    return df.select(*out_cols, *last)


def constant_columns(df: DataFrame, protected: list[str] | None = None, extra_aggs=None):
    """Names of columns with at most one distinct value, NULL counted as a
    value; one aggregate (min, max, non-null count, row count), no distinct.
    Text is compared by its hash, as text cannot be updated in place in an
    aggregate's buffer; texts whose hashes all agree are compared themselves."""
    protected = set(protected or [])
    names = [c for c in df.columns if c not in protected]
    text = {c for c in names if isinstance(df.schema[c].dataType, T.StringType)}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        value = F.when(col.isNotNull(), F.xxhash64(col)) if c in text else col
        aggs += [F.min(value).alias(f"mn{i}"), F.max(value).alias(f"mx{i}"), F.count(col).alias(f"nn{i}")]
    aggs += list(extra_aggs or [])
    row = df.agg(*aggs).collect()[0]
    n = row["__n"]
    dropped = []
    for i, c in enumerate(names):
        nn = row[f"nn{i}"]
        if nn == 0 or (nn == n and row[f"mn{i}"] == row[f"mx{i}"]):
            dropped.append(c)
    doubtful = [c for c in dropped if c in text and row[f"nn{names.index(c)}"]]
    if doubtful:
        ends = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(doubtful) for k, f in (("mn", F.min), ("mx", F.max))]).collect()[0]
        varied = {c for i, c in enumerate(doubtful) if ends[f"mn{i}"] != ends[f"mx{i}"]}
        dropped = [c for c in dropped if c not in varied]
    return dropped, row


def derived(raw: DataFrame, roles: Roles = Roles(), options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """The cleaned and enriched rows, before any choice that depends on the
    options' length transform."""
    df = derive(raw, roles, options)
    return df.withColumn(roles.length_log1p, log1p_clip(roles.length_num)) if roles.length_num in df.columns else df


def prepare(
    raw: DataFrame, roles: Roles = Roles(), options: PrepareOptions = PrepareOptions(), materialize: bool = False
) -> tuple[DataFrame, PrepareReport]:
    """Clean and enrich; return the table and the facts decided on the way.

    ``materialize`` writes the derived table once to the shared checkpoint
    folder, so the aggregates below and every later use scan it instead of
    re-running the row work."""
    df = derived(raw, roles, options)
    if materialize:
        from ..session import compiled_rows
        from ..session import materialize as write_once

        with compiled_rows(df.sparkSession):
            df = write_once(df, "derived")
    return finish(df, roles, options)


def finish(df: DataFrame, roles: Roles = Roles(), options: PrepareOptions = PrepareOptions()) -> tuple[DataFrame, PrepareReport]:
    """``prepare`` from the ``derived`` rows on: length transform and constant
    columns. One derived table serves every choice of the transform."""
    method = (options.length_transform or "none").lower()
    has_length = roles.length_num in df.columns
    bounds = None
    if has_length:
        if method == "winsor":
            q = exact_quantiles(df, [roles.length_num], [options.winsor_low, options.winsor_high])
            lo, hi = q[(roles.length_num, options.winsor_low)], q[(roles.length_num, options.winsor_high)]
            if lo is not None:
                bounds = (lo, hi)
                df = df.withColumn(roles.length_winsor, clip(roles.length_num, lo, hi))
    protected = [options.target] if options.target else []
    extra = []
    if has_length:
        extra = [F.count(roles.length_num).alias("__len_n"), sample_skew(roles.length_num).alias("__len_skew")]
    dropped, row = constant_columns(df, protected, extra)

    if not has_length:
        report = PrepareReport(roles.length_num, "missing", None, False)
    elif row["__len_n"] == 0:
        df = df.drop(roles.length_log1p)
        if roles.length_winsor in df.columns:
            df = df.drop(roles.length_winsor)
        report = PrepareReport(roles.length_num, "none", None, False)
    else:
        applied = "winsor" if bounds is not None else ("log1p" if method == "log1p" else "none")
        report = PrepareReport(roles.length_log1p, applied, row["__len_skew"], True, [], bounds)
    dropped = [c for c in dropped if c in df.columns]
    df = df.drop(*dropped)
    report = PrepareReport(
        report.length_feature,
        report.length_transform,
        report.length_skewness,
        report.length_raw_excluded,
        dropped,
        report.winsor_bounds,
    )
    return df, report
