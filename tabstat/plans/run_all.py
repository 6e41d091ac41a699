"""The full flow on one prepared table: profile, normality, PCA, both
regression models (or the classification models), report tables, findings.

Every result is a stage written to ``out_dir`` (parquet, one folder per
table; models as pipelines). A manifest beside them holds what is finished,
keyed by the input's files and the options (``manifest``): a flow that is
started again goes on behind its last finished stage, and changed data make
every stage anew.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelOptions, Roles
from ..operators import classify as clf
from ..operators import normality as nt
from ..operators import profile as prof
from ..operators.classify import LOGIT_SCHEMA, TRACE_SCHEMA
from ..operators.columns import schema_profile
from ..operators.linear import LinearModel, high_vif
from ..operators.pca import biplot_arrows, pca_fit
from ..sources import sinks
from . import report
from .manifest import Manifest, fingerprint_of_frame
from .model import CLF_METRICS_SCHEMA, feature_matrix, residual_points, run_classification, run_regression, tied


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flow_key(obs: DataFrame, options: ModelOptions, roles: Roles) -> str:
    """What the flow's results depend on."""
    return hashlib.sha256(json.dumps([fingerprint_of_frame(obs), asdict(options), asdict(roles)]).encode()).hexdigest()


def run_all(spark: SparkSession, obs: DataFrame, out_dir: str, options: ModelOptions = ModelOptions(),
            roles: Roles = Roles()) -> tuple[DataFrame, dict[str, str]]:
    """Return (findings lines, {table name: path})."""
    flow = Manifest(spark, out_dir, flow_key(obs, options, roles))
    _profile(flow, obs, options, roles)
    if options.task == "clf":
        coefs = _classification(flow, obs, options, roles)
    else:
        coefs = _regression(flow, obs, options, roles)
    table = lambda name: spark.read.parquet(flow.paths[name])
    coef_lines = [report.coefficient_lines(c, label, verb) for c, (label, verb) in zip(coefs, (("Modelo 1", "resalta"), ("Modelo 2", "identifica")))]
    lines = flow.table("findings", lambda: report.findings(
        spark, table("correlation_pairs"), prof.group_mean(obs, roles.peak, roles.speed_num, "speed_mean"),
        prof.group_argmin(table("group_summary"), roles.district, "speed_mean"), table("missing_report"), coef_lines, roles))
    section_order = F.when(F.col("section") == "findings", 0).when(F.col("section") == "limits", 1).otherwise(2)
    return lines.orderBy(section_order, F.col("line_no")), flow.paths


def _profile(flow: Manifest, obs: DataFrame, options: ModelOptions, roles: Roles) -> None:
    spark = obs.sparkSession
    num = [c for c in roles.numeric_order() if c in obs.columns]
    cat = [c for c in roles.categorical() if c in obs.columns]
    known: dict = {}
    flow.table("numeric_summary", lambda: prof.numeric_summary(obs, num, keep=known))
    flow.table("categorical_profile", lambda: prof.categorical_profile(obs, cat))
    flow.table("missing_report", lambda: prof.missing_report(obs))
    corr = flow.table("correlation_matrix", lambda: prof.correlation_long(obs, num))
    flow.table("correlation_pairs", lambda: prof.correlation_pairs(corr, num))
    flow.table("histogram_bins", lambda: prof.histogram_bins(obs, num, known=known or None))
    flow.table("density_grid", lambda: _union([prof.density_grid(obs, c) for c in num]))
    flow.table("boxplot_stats", lambda: prof.boxplot_stats(obs, num, known=known or None))
    flow.table("category_counts", lambda: _union([prof.category_counts(obs, c, options.top_categories) for c in cat]))
    flow.table("group_summary", lambda: prof.group_summary(obs, roles))

    normal = functools.cache(lambda: nt.normality_auto(obs, num, roles.speed_num, "auto" if options.normality_test == "k2" else options.normality_test, options.shapiro_max_n))
    if num:
        flow.table("normality", lambda: spark.createDataFrame([normal().as_row()] if normal() else [], nt.RESULT_SCHEMA))
        flow.stage("normality_text", lambda path: sinks.sink_text(spark, nt.summary_lines(normal()) if normal() else [], path, "normality"))
        shown = roles.speed_num if roles.speed_num in num else num[0]
        flow.table("qq_points", lambda: nt.qq_points(obs, shown, options.point_limit)[0])

    pca = functools.cache(lambda: pca_fit(obs, num))
    flow.table("pca_variance", lambda: spark.createDataFrame(pca().variance_rows() if pca() else [], "component string, var_exp double, var_exp_cum double, k int"))
    loadings = lambda: [(f"PC{k + 1}", *r) for k in range(min(2, len(num))) for r in pca().loading_rows(k)] if pca() else []
    flow.table("pca_loadings", lambda: spark.createDataFrame(loadings(), "component string, variable string, loading double, rank int"))
    flow.table("pca_biplot", lambda: spark.createDataFrame(biplot_arrows(obs, pca()) if pca() else [], "variable string, x double, y double, labelled boolean"))


def _shared_tables(flow: Manifest, run, options: ModelOptions, trace_schema: str) -> None:
    spark = flow.spark
    vif = lambda: run().vif or []
    flow.table("feature_matrix", lambda: feature_matrix(run().data))
    flow.table("vif", lambda: spark.createDataFrame(vif(), "variable string, vif double"))
    flow.table("vif_high", lambda: spark.createDataFrame(high_vif(vif(), options.vif_threshold), "variable string, vif double"))
    flow.table("selection_trace", lambda: spark.createDataFrame(run().trace, trace_schema))


def _classification(flow: Manifest, obs: DataFrame, options: ModelOptions, roles: Roles) -> list[DataFrame]:
    spark = flow.spark
    run = functools.cache(lambda: run_classification(obs, options, roles))
    flow.table("metrics", lambda: spark.createDataFrame(run().metrics, CLF_METRICS_SCHEMA))
    coefs = [flow.table("model1_coefficients", lambda: spark.createDataFrame(run().coef1, LOGIT_SCHEMA)),
             flow.table("model2_coefficients", lambda: spark.createDataFrame(run().coef2, LOGIT_SCHEMA))]
    for i in (1, 2):
        model = functools.cache(lambda i=i: run().model1 if i == 1 else run().model2)
        pred = flow.table(f"model{i}_predictions", lambda m=model: m().predict(run().data.test, [run().data.key, run().data.target]))
        flow.table(f"model{i}_confusion", lambda p=pred: clf.confusion_grid(p, run().data.target, run().classes))
        for name, curve in (("roc", clf.roc_curve), ("pr", clf.pr_curve)):
            if not flow.finished(f"model{i}_{name}") and len(run().classes) != 2:
                continue
            flow.table(f"model{i}_{name}", lambda p=pred, c=curve: c(tied(p), run().data.target, run().positive))
        flow.stage(f"model{i}", lambda path, m=model: sinks.model_store(PipelineModel(stages=[*run().data.pre.stages(), m().stage]), path))
    _shared_tables(flow, run, options, TRACE_SCHEMA)
    return coefs


def _regression(flow: Manifest, obs: DataFrame, options: ModelOptions, roles: Roles) -> list[DataFrame]:
    spark = flow.spark
    run = functools.cache(lambda: run_regression(obs, options, roles))
    flow.table("metrics", lambda: run().metrics_df(spark))
    coefs = [flow.table("model1_coefficients", lambda: run().coef_df(spark, 1)), flow.table("model2_coefficients", lambda: run().coef_df(spark, 2))]

    def diagnostics():
        found = [(m, res.diagnostics) for m, res in (("modelo1", run().ols1), ("modelo2", run().ols2))]
        rows = [(m, k, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v)) for m, d in found for k, v in d.items() if v is not None]
        return spark.createDataFrame(rows, "model string, name string, text string, value double")

    flow.table("residual_diagnostics", diagnostics)
    for i in (1, 2):
        model = functools.cache(lambda i=i: run().model1 if i == 1 else run().model2)
        fit = functools.cache(lambda i=i: run().ols1 if i == 1 else run().ols2)
        flow.stage(f"model{i}_diagnostics_text", lambda path, f=fit: sinks.sink_text(spark, report.diagnostic_lines(f().diagnostics), path, "diagnostics"))
        points = flow.table(f"model{i}_residuals", lambda m=model: residual_points(run().data, m()))
        train, test = points.where("split = 'train'"), points.where("split = 'test'")
        flow.table(f"model{i}_residual_grid", lambda p=train: prof.point_grid(p, "predicted", "residual", options.grid_bins))
        flow.table(f"model{i}_actual_grid", lambda p=test: prof.point_grid(p, "actual", "predicted", options.grid_bins))
        flow.table(f"model{i}_residual_qq", lambda p=train: nt.qq_points(p, "residual", options.point_limit)[0])
        flow.stage(f"model{i}", lambda path, m=model: sinks.model_store(PipelineModel(stages=[*run().data.pre.stages(), LinearModel.of(m())]), path))
    _shared_tables(flow, run, options, "step int, feature string, score double")
    flow.table("report_tables", lambda: spark.createDataFrame(report.report_rows(run(), schema_profile(obs), obs.columns, roles), report.REPORT_SCHEMA))
    return coefs
