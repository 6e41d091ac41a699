"""Registered queries for sources/sinks, the end-to-end flows, the model
tables and the findings text. Model runs are shared per application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ModelOptions, Roles
from ..operators import profile as prof
from ..operators.columns import schema_profile
from ..operators.linear import COEF_SCHEMA, ols_with_checks
from ..operators.pca import pca_fit
from ..session import scratch_path
from ..sources import csv as csvsrc
from ..sources import sinks
from ..sources.fixtures import content_key, raw_obs
from . import report
from .model import CLF_METRICS_SCHEMA, feature_matrix, residual_points, run_classification, run_regression
from .q_model import _reg_frame, active_dummies
from .q_rows import _obs

R = Roles()
_RUNS: dict[tuple, object] = {}


# fixed values: result tables and columns of the profile, (query, key columns,
# value columns) by part
PROFILE_PARTS = {
    "numeric_summary": ("numeric_summary", ["variable"], ["count", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis"]),
    "categorical_profile": ("categorical_profile", ["variable", "top"], ["n_distinct", "freq_top"]),
    "category_counts": ("category_counts_topk", ["variable", "value"], ["count"]),
    "missing_report": ("missing_report", ["variable"], ["n_missing", "pct_missing"]),
    "correlation_matrix": ("correlation_matrix", ["var1", "var2"], ["corr"]),
    "histogram_bins": ("histogram_bins", ["variable", "bin"], ["lower", "upper", "count"]),
    "density_grid": ("density_grid", ["variable", "point"], ["x", "density"]),
    "boxplot_stats": ("boxplot_stats", ["variable"], ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]),
    "group_summary": ("group_summary", ["district"], ["n_segments", "speed_mean", "speed_std", "length_mean", "duration_min_mean"]),
}


def _key(spark, sf_dir, kind):
    return content_key(spark, sf_dir), kind


def regression_run(spark, sf_dir):
    k = _key(spark, sf_dir, "reg")
    if k not in _RUNS:
        df, _ = _obs(spark, sf_dir)
        _RUNS[k] = run_regression(df, ModelOptions(), R)
    return _RUNS[k]


def classification_run(spark, sf_dir):
    k = _key(spark, sf_dir, "clf")
    if k not in _RUNS:
        df, _ = _obs(spark, sf_dir)
        _RUNS[k] = run_classification(df, ModelOptions(task="clf", target=R.label), R)
    return _RUNS[k]


# ----------------------------------------------------------------------------- sources and sinks


def q_scan_csv(spark, sf_dir):
    path = scratch_path(spark, "obs-csv")
    (raw_obs(spark, sf_dir).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return csvsrc.scan_csv(spark, path)


def q_sink_table(spark, sf_dir):
    path = scratch_path(spark, "group-summary")
    sinks.sink_table(prof.group_summary(_obs(spark, sf_dir)[0], R), path)
    return spark.read.parquet(path)


def q_scan_result_table(spark, sf_dir):
    path = scratch_path(spark, "group-summary-csv")
    sinks.sink_table(prof.group_summary(_obs(spark, sf_dir)[0], R), path, fmt="csv")
    return csvsrc.scan_result_table(spark, path, columns=[R.district, "speed_mean", "speed_std", "absent"], head=10,
                                    round_map={"speed_mean": 1, "speed_std": 1}, order_by=[R.district])


def q_sink_feature_matrix(spark, sf_dir):
    run = regression_run(spark, sf_dir)
    md = run.data
    path = scratch_path(spark, "features")
    sinks.sink_feature_matrix([("train", md.train), ("test", md.test)], md.names, md.key, path)
    back = spark.read.parquet(path)
    return back.select(md.key, "split", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in md.lists.numeric])


def q_sink_text(spark, sf_dir):
    from ..operators import normality as nt

    df, _ = _obs(spark, sf_dir)
    cols = [c for c in R.numeric_order() if c in df.columns]
    res = nt.normality_auto(df, cols, R.speed_num)
    path = scratch_path(spark, "normality-text")
    sinks.sink_text(spark, nt.summary_lines(res), path, section="normality")
    return sinks.read_text(spark, path)


def q_model_store(spark, sf_dir):
    """Save the fitted preprocessing chain, load it back and transform."""
    from pyspark.ml import PipelineModel

    run = regression_run(spark, sf_dir)
    pre = run.data.pre
    path = scratch_path(spark, "preprocess-model")
    sinks.model_store(PipelineModel(stages=pre.stages()), path)
    loaded = sinks.model_load(path)
    s, _, _ = _reg_frame(spark, sf_dir)
    out = loaded.transform(s)
    return out.select(R.key, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in pre.numeric], active_dummies(pre.names, pre.numeric))


# ----------------------------------------------------------------------------- regression flow tables


def q_model_regression(spark, sf_dir):
    metrics = regression_run(spark, sf_dir).metrics_df(spark)
    return metrics.select("model", *[F.round(c, 6).alias(c) for c in ("rmse", "r2", "mae", "bias")])


def q_coef_union_dropped(spark, sf_dir):
    """Model 1 with one more feature that never varies: it is dropped from the
    fit and listed without numbers."""
    md = regression_run(spark, sf_dir).data
    train = md.train.withColumn("flat", F.lit(2.5))
    res = ols_with_checks(train, [*md.names, "flat"], md.target, diagnostics=False)
    coef = spark.createDataFrame(res.table_rows(), COEF_SCHEMA)
    return coef.select("variable", *[F.round(c, 6).alias(c) for c in ("coef", "std_err", "p_value")], "note")


def q_top_coefficients(spark, sf_dir):
    coef = regression_run(spark, sf_dir).coef_df(spark, 1)
    return report.top_coefficients(coef, 5).select("rank", "variable", F.round("coef", 3).alias("coef"),
                                                    F.round("p_value", 4).alias("p_value"))


def q_ols_checks(spark, sf_dir):
    run = regression_run(spark, sf_dir)
    rows = []
    for label, res in (("modelo1", run.ols1), ("modelo2", run.ols2)):
        rows.append((label, res.source, res.n, len(res.names), res.rank, float(res.df_resid), ",".join(res.issues),
                     ",".join(res.dropped)))
    return spark.createDataFrame(rows, "model string, source string, n long, p int, rank int, df_resid double, "
                                       "issues string, dropped string")


def q_ridge_fallback(spark, sf_dir):
    """A doubled feature makes Z rank deficient: the checks send the fit to
    ridge (alpha = 1, intercept unpenalised)."""
    s, _, target = _reg_frame(spark, sf_dir)
    train = s.where("split = 'train'").select(R.length_log1p, F.col(R.length_log1p).alias("length_log1p_copy"), target)
    res = ols_with_checks(train, [R.length_log1p, "length_log1p_copy"], target, diagnostics=False)
    rows = [(r[0], None if r[1] is None else round(r[1], 6), r[2], r[3], r[4]) for r in res.table_rows()]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def q_vif(spark, sf_dir):
    run = regression_run(spark, sf_dir)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in run.vif], "variable string, vif double")


def q_compare_models(spark, sf_dir):
    run = regression_run(spark, sf_dir)
    md = run.data
    p1 = residual_points(md, run.model1).where("split = 'test'").withColumn("model", F.lit("modelo1"))
    p2 = residual_points(md, run.model2).where("split = 'test'").withColumn("model", F.lit("modelo2"))
    return p1.unionByName(p2).select("model", md.key, "actual", F.round("predicted", 6).alias("predicted"),
                                     F.round("residual", 6).alias("residual"))


def q_report_tables(spark, sf_dir):
    """The report's five tables in one long form."""
    df, _ = _obs(spark, sf_dir)
    rows = report.report_rows(regression_run(spark, sf_dir), schema_profile(df), df.columns, R)
    return spark.createDataFrame(rows, report.REPORT_SCHEMA)


def q_forward_select_regression(spark, sf_dir):
    """Every step of the selection with its cross-validated score."""
    trace = spark.createDataFrame(regression_run(spark, sf_dir).trace, "step int, feature string, score double")
    return trace.withColumn("score", F.round("score", 6))


def q_vif_sorted(spark, sf_dir):
    """The largest 15 VIFs of all numeric features, with the threshold's verdict."""
    limit = ModelOptions().vif_threshold
    rows = sorted(regression_run(spark, sf_dir).vif, key=lambda r: (-round(r[1], 6), r[0]))[:15]
    return spark.createDataFrame([(i, c, round(v, 6), v > limit) for i, (c, v) in enumerate(rows, 1)], "rank int, variable string, vif double, high boolean")


def q_residual_grid(spark, sf_dir):
    """Fitted value against residual of model 1 over the training rows, as
    counts on a 40 x 40 grid."""
    run = regression_run(spark, sf_dir)
    points = residual_points(run.data, run.model1).where("split = 'train'")
    return prof.point_grid(points, "predicted", "residual", 40).select("x_bin", "y_bin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "count")


def q_feature_matrix(spark, sf_dir):
    md = regression_run(spark, sf_dir).data
    fm = feature_matrix(md)
    return fm.select(md.key, "split", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in md.names])


# ----------------------------------------------------------------------------- classification flow tables


def q_model_classification(spark, sf_dir):
    metrics = spark.createDataFrame(classification_run(spark, sf_dir).metrics, CLF_METRICS_SCHEMA)
    return metrics.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


def q_compare_models_classification(spark, sf_dir):
    """Predictions, confusion counts, ROC and PR points of both models over
    the test rows: (model, part, name, x, y)."""
    from .model import compare_classification

    out = compare_classification(classification_run(spark, sf_dir))
    return out.select("model", "part", "name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def q_logistic_fit_predict(spark, sf_dir):
    run = classification_run(spark, sf_dir)
    md = run.data
    p = run.model1.predict(md.test, [md.key, md.target])
    return p.select(md.key, F.round("proba", 6).alias("proba"), "predicted")


def q_logit_inference(spark, sf_dir):
    from ..operators.classify import LOGIT_SCHEMA

    coef = spark.createDataFrame(classification_run(spark, sf_dir).coef1, LOGIT_SCHEMA)
    digits = {"coef": 6, "std_err": 4, "p_value": 4, "odds_ratio": 4}
    return coef.select("variable", *[F.round(c, d).alias(c) for c, d in digits.items()], "note")


def q_forward_select_classification(spark, sf_dir):
    from ..operators.classify import TRACE_SCHEMA

    trace = spark.createDataFrame(classification_run(spark, sf_dir).trace, TRACE_SCHEMA)
    return trace.withColumn("score", F.round("score", 6))


# ----------------------------------------------------------------------------- PCA (full), profile, findings


def q_pca_fit(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    cols = [c for c in R.numeric_order() if c in df.columns]
    res = pca_fit(df, cols)
    return spark.createDataFrame(res.variance_rows(), "component string, var_exp double, var_exp_cum double, k int")


def q_profile(spark, sf_dir):
    """All profile tables in one: (part, row, name, value)."""
    from .registry import QUERIES as TABLES

    out = None
    for part, (query, keys, values) in PROFILE_PARTS.items():
        row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        cells = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
        rows = TABLES[query](spark, sf_dir).select(F.lit(part).alias("part"), row.alias("row"), F.explode(cells).alias("c")).select("part", "row", "c.name", "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _findings_inputs(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    num = [c for c in R.numeric_order() if c in df.columns]
    corr = prof.correlation_pairs(prof.correlation_long(df, num), num)
    peak = prof.group_mean(df, R.peak, R.speed_num, "speed_mean")
    slow = prof.group_argmin(prof.group_summary(df, R), R.district, "speed_mean")
    miss = prof.missing_report(df)
    return corr, peak, slow, miss


def q_findings(spark, sf_dir):
    return report.findings(spark, *_findings_inputs(spark, sf_dir))


def q_format_findings(spark, sf_dir):
    """The sentences of the findings and each model's diagnostics text."""
    corr, peak, slow, miss = _findings_inputs(spark, sf_dir)
    found = report.findings(spark, corr, peak, slow, miss).where("section = 'findings' and line_no > 1")
    run = regression_run(spark, sf_dir)
    lines = [(f"diagnostics_{m}", i, t) for m, res in (("modelo1", run.ols1), ("modelo2", run.ols2)) for i, t in enumerate(report.diagnostic_lines(res.diagnostics), 1)]
    return found.unionByName(spark.createDataFrame(lines, "section string, line_no int, text string"))


# fixed values: written tables of the full flow, with their key and value
# columns, that are compared beside the findings text
FLOW_PARTS = {
    **{part: (keys, values) for part, (_, keys, values) in PROFILE_PARTS.items()},
    "metrics": (["model"], ["rmse", "r2", "mae", "bias"]),
    "vif": (["variable"], ["vif"]),
    "selection_trace": (["step", "feature"], ["score"]),
    "report_tables": (["part", "ord", "name", "text"], ["value", "p_value", "std_err"]),
}


def q_run_all(spark, sf_dir):
    """Full flow on the prepared table: every result table is written to a
    folder under the shared checkpoint folder and read back: (part, row, name,
    value, text) of the tables of FLOW_PARTS and the findings text."""
    from .run_all import run_all

    df, _ = _obs(spark, sf_dir)
    lines, written = run_all(spark, df, scratch_path(spark, "run-all"), ModelOptions(), R)
    nothing = F.lit(None)
    out = lines.select(F.lit("findings").alias("part"), F.concat_ws("|", "section", F.col("line_no").cast("string")).alias("row"),
                       F.lit("text").alias("name"), nothing.cast("double").alias("value"), "text")
    for part, (keys, values) in FLOW_PARTS.items():
        table = spark.read.parquet(written[part])
        if part == "density_grid":
            table = table.where(F.col("variable") == R.speed_num)
        row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        cells = F.array(*[F.struct(F.lit(v).alias("name"), F.round(F.col(v).cast("double"), 6).alias("value")) for v in values])
        cells = table.select(F.lit(part).alias("part"), row.alias("row"), F.explode(cells).alias("c"))
        out = out.unionByName(cells.select("part", "row", "c.name", "c.value", nothing.cast("string").alias("text")))
    return out


QUERIES = {
    "scan_csv": q_scan_csv,
    "scan_result_table": q_scan_result_table,
    "sink_table": q_sink_table,
    "sink_feature_matrix": q_sink_feature_matrix,
    "sink_text": q_sink_text,
    "model_store": q_model_store,
    "ols_checks": q_ols_checks,
    "ridge_fallback": q_ridge_fallback,
    "coef_union_dropped": q_coef_union_dropped,
    "top_coefficients": q_top_coefficients,
    "vif": q_vif,
    "pca_fit": q_pca_fit,
    "compare_models": q_compare_models,
    "report_tables": q_report_tables,
    "forward_select_regression": q_forward_select_regression,
    "vif_sorted": q_vif_sorted,
    "residual_grid": q_residual_grid,
    "model_regression": q_model_regression,
    "model_classification": q_model_classification,
    "compare_models_classification": q_compare_models_classification,
    "logistic_fit_predict": q_logistic_fit_predict,
    "logit_inference": q_logit_inference,
    "forward_select_classification": q_forward_select_classification,
    "profile": q_profile,
    "findings": q_findings,
    "format_findings": q_format_findings,
    "run_all": q_run_all,
}

