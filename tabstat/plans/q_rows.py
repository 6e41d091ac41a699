"""Registered queries for the row-level operators (cleaning, typing, times,
durations, labels, transforms) and the column-list steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ModelOptions, PrepareOptions, Roles
from ..functions.duration import fill_duration_minutes, parse_duration
from ..functions.numeric import log1p_clip, threshold_label
from ..functions.text import clean_text, coerce_numeric
from ..functions.time import (
    circular_midpoint,
    cyclic_encode,
    hour_fraction,
    midnight_rollover,
    parse_datetime,
    peak_flag,
    seconds_between,
)
from ..operators import columns
from ..operators import features as feat
from ..sources.fixtures import raw_obs
from .prepare import constant_columns, derive

R = Roles()


def _raw(spark, sf_dir):
    return raw_obs(spark, sf_dir)


def _obs(spark, sf_dir, options=PrepareOptions()):
    from .registry import prepared

    return prepared(spark, sf_dir, options)


def _times(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    t0 = parse_datetime(R.day, R.start)
    t1 = parse_datetime(R.day, R.end)
    cleaned = raw.select(R.key, *[clean_text(c).alias(c) for c in (R.day, R.start, R.end, R.duration_text)])
    return cleaned.select(R.key, R.duration_text, t0.alias("t0"), t1.alias("t1_raw"))


def q_clean_text(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(R.key, *[clean_text(c).alias(c) for c in R.text_columns()])


def q_coerce_numeric(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(R.key, *[coerce_numeric(t).alias(n) for t, n in R.numeric_text()])


def q_parse_datetime(spark, sf_dir):
    t = _times(spark, sf_dir)
    return t.select(R.key, F.col("t0").cast("string").alias("dt_start"), F.col("t1_raw").cast("string").alias("dt_end_raw"))


def q_midnight_rollover(spark, sf_dir):
    t = _times(spark, sf_dir)
    t1 = midnight_rollover(F.col("t0"), F.col("t1_raw"))
    return t.select(R.key, t1.cast("string").alias("dt_end"), (F.col("t1_raw") < F.col("t0")).alias("rolled"))


def q_parse_duration(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    h, m = parse_duration(R.duration_text)
    hs, ms = parse_duration(R.duration_text, sum_parts=True)
    return raw.select(R.key, R.duration_text, h.alias("hours"), m.alias("minutes"),
                      F.round(hs, 9).alias("hours_summed"), ms.alias("minutes_summed"))


def q_fill_duration(spark, sf_dir):
    t = _times(spark, sf_dir)
    t1 = midnight_rollover(F.col("t0"), F.col("t1_raw"))
    h, m = parse_duration(R.duration_text)
    return t.select(R.key, F.round(fill_duration_minutes(h, m, seconds_between(F.col("t0"), t1)), 6).alias("duration_min"))


def _hours(spark, sf_dir):
    t = _times(spark, sf_dir)
    t1 = midnight_rollover(F.col("t0"), F.col("t1_raw"))
    return t.select(R.key, hour_fraction(F.col("t0")).alias("start_hour"), hour_fraction(t1).alias("end_hour"))


def q_hour_fraction(spark, sf_dir):
    h = _hours(spark, sf_dir)
    return h.select(R.key, F.round("start_hour", 9).alias("start_hour"), F.round("end_hour", 9).alias("end_hour"))


def q_peak_flag(spark, sf_dir):
    h = _hours(spark, sf_dir)
    return h.select(R.key, peak_flag(F.col("start_hour")).alias("peak"))


def q_circular_midpoint(spark, sf_dir):
    h = _hours(spark, sf_dir)
    return h.select(R.key, F.round(circular_midpoint(F.col("start_hour"), F.col("end_hour")), 9).alias("mid_hour"))


def q_cyclic_encode(spark, sf_dir):
    h = _hours(spark, sf_dir)
    s, c = cyclic_encode(circular_midpoint(F.col("start_hour"), F.col("end_hour")))
    return h.select(R.key, F.round(s, 9).alias("hour_sin"), F.round(c, 9).alias("hour_cos"))


def _typed(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(R.key, *[coerce_numeric(t).alias(n) for t, n in R.numeric_text()])


def q_threshold_label(spark, sf_dir):
    return _typed(spark, sf_dir).select(R.key, threshold_label(R.speed_num).alias("target_bin"))


def q_log1p_clip(spark, sf_dir):
    return _typed(spark, sf_dir).select(R.key, F.round(log1p_clip(R.length_num), 9).alias("length_log1p"))


def q_winsorize(spark, sf_dir):
    df, rep = _obs(spark, sf_dir, PrepareOptions(length_transform="winsor"))
    return df.select(R.key, F.round(R.length_winsor, 9).alias("length_winsor"))


def q_transform_dispatch(spark, sf_dir):
    rows = []
    for method in ("none", "log1p", "winsor"):
        _, rep = _obs(spark, sf_dir, PrepareOptions(length_transform=method))
        rows.append((method, rep.length_transform, rep.length_feature, rep.length_raw_excluded,
                     None if rep.length_skewness is None else round(rep.length_skewness, 6)))
    return spark.createDataFrame(rows, "method string, applied string, feature string, raw_excluded boolean, skewness double")


def _listed(spark, df, rows):
    """The rows (pos, variable, ...) with the number of values of each column."""
    names = spark.createDataFrame(rows, "pos int, variable string, kind string")
    return names.join(columns.present(df, [r[1] for r in rows]), "variable")


def q_drop_columns(spark, sf_dir):
    """The derived table without the helper columns: its columns and how many
    values each has."""
    df = derive(_raw(spark, sf_dir), R)
    helpers = {"start_hour": hour_fraction(F.col(R.dt_start)), "end_hour": hour_fraction(F.col(R.dt_end))}
    out = df.withColumns(helpers).drop("start_hour", "end_hour", "mid_hour", "duration_hours")
    return _listed(spark, out, [(i, c, "") for i, c in enumerate(out.columns)]).select("pos", "variable", "n_present")


def q_drop_constant_columns(spark, sf_dir):
    df = derive(_raw(spark, sf_dir), R).withColumn(R.length_log1p, log1p_clip(R.length_num))
    dropped, _ = constant_columns(df)
    return spark.createDataFrame([(c,) for c in dropped], "variable string")


def _numeric_obs(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    cols = [c for c in R.numeric_order() if c in df.columns]
    return df, cols


def _variance_rows(spark, rows, name):
    rows = [(c, None if v is None else round(v, 6), flag) for c, v, flag in rows]
    return spark.createDataFrame(rows, f"variable string, var_pop double, {name} boolean")


def q_near_constant_filter(spark, sf_dir):
    return _variance_rows(spark, columns.near_constant_filter(*_numeric_obs(spark, sf_dir))[1], "kept")


def q_zero_variance_drop(spark, sf_dir):
    df = derive(_raw(spark, sf_dir), R).withColumn(R.length_log1p, log1p_clip(R.length_num))
    cols = [c for c in R.numeric_order() if c in df.columns]
    return _variance_rows(spark, columns.zero_variance_drop(df, cols)[1], "dropped")


def q_impute_mean(spark, sf_dir):
    df, cols = _numeric_obs(spark, sf_dir)
    return columns.impute_mean(df, cols).select(R.key, *[F.round(c, 6).alias(c) for c in cols])


def q_drop_missing_rows(spark, sf_dir):
    """Rows with a target, and which of them have all features."""
    df, _ = _obs(spark, sf_dir)
    fl = feat.select_features(df, R.speed_num, ModelOptions(), R)
    whole = columns.drop_missing_rows(df, R.speed_num, fl.all).select(R.key, F.lit(True).alias("complete"))
    out = columns.drop_missing_rows(df, R.speed_num).select(R.key).join(whole, R.key, "left")
    return out.select(R.key, F.coalesce("complete", F.lit(False)).alias("complete"))


def q_fill_label(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    return df.select(R.key, columns.fill_label(R.street).alias(R.street))


def q_select_features(spark, sf_dir):
    df, rep = _obs(spark, sf_dir)
    target, _ = feat.choose_target_task(df, ModelOptions(), R)
    fl = feat.select_features(df, target, ModelOptions(), R)
    rows = [(i, c, "numeric" if c in fl.numeric else "categorical") for i, c in enumerate(fl.all)]
    return _listed(spark, df, rows).select("pos", F.col("variable").alias("feature"), "kind", "n_present")


def q_choose_target_task(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    rows = []
    for task in ("auto", "clf"):
        opts = ModelOptions(task=task, target=R.label if task == "clf" else None)
        target, kind = feat.choose_target_task(df, opts, R)
        k = df.agg(F.count_distinct(F.col(target)).alias("k")).collect()[0]["k"]
        rows.append((task, target, kind, k))
    return spark.createDataFrame(rows, "option string, target string, task string, n_distinct long")


def q_schema_profile(spark, sf_dir):
    return spark.createDataFrame(columns.schema_profile(_obs(spark, sf_dir)[0]), "indicator string, value long")


def q_round_columns(spark, sf_dir):
    from ..functions.present import round_columns

    df, _ = _obs(spark, sf_dir)
    out = round_columns(df.select(R.key, R.length_log1p, R.hour_sin, R.duration_min, R.peak),
                        {R.length_log1p: 2, R.hour_sin: 3, R.duration_min: 1, R.peak: 2, "absent": 2})
    return out


def q_label_encode_binary(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    classes = [r[0] for r in df.select(R.label).distinct().collect()]
    pos = feat.positive_class(classes)
    return df.select(R.key, columns.label_encode_binary(R.label, pos).alias("y"))


def q_obs_enriched(spark, sf_dir):
    return _raw(spark, sf_dir)


QUERIES = {
    "obs_enriched": q_obs_enriched,
    "clean_text": q_clean_text,
    "coerce_numeric": q_coerce_numeric,
    "parse_datetime": q_parse_datetime,
    "midnight_rollover": q_midnight_rollover,
    "parse_duration": q_parse_duration,
    "fill_duration": q_fill_duration,
    "hour_fraction": q_hour_fraction,
    "peak_flag": q_peak_flag,
    "circular_midpoint": q_circular_midpoint,
    "cyclic_encode": q_cyclic_encode,
    "threshold_label": q_threshold_label,
    "log1p_clip": q_log1p_clip,
    "winsorize": q_winsorize,
    "transform_dispatch": q_transform_dispatch,
    "drop_columns": q_drop_columns,
    "drop_constant_columns": q_drop_constant_columns,
    "near_constant_filter": q_near_constant_filter,
    "zero_variance_drop": q_zero_variance_drop,
    "impute_mean": q_impute_mean,
    "drop_missing_rows": q_drop_missing_rows,
    "fill_label": q_fill_label,
    "select_features": q_select_features,
    "choose_target_task": q_choose_target_task,
    "schema_profile": q_schema_profile,
    "round_columns": q_round_columns,
    "label_encode_binary": q_label_encode_binary,
}
