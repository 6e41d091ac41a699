"""What the full flow writes, and faults found by probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.config import ModelOptions, Roles
from tabstat.operators.classify import forward_select_classification
from tabstat.operators.columns import impute_mean, near_constant_filter, zero_variance_drop
from tabstat.operators.linear import vif_table
from tabstat.operators.pca import pca_fit
from tabstat.plans.q_rows import _obs
from tabstat.plans.run_all import run_all
from tabstat.session import scratch_path
from tabstat.sources.csv import scan_result_table
from tabstat.sources.sinks import model_load
from tests.conftest import SF001

R = Roles()


def test_regression_flow_writes_models_and_diagnostics(spark):
    df, _ = _obs(spark, SF001)
    lines, written = run_all(spark, df, scratch_path(spark, "flow"), ModelOptions(), R)
    assert {"residual_diagnostics", "model1_residuals", "model2_residual_qq", "feature_matrix", "vif_high", "model1", "model2"} <= set(written)
    test = spark.read.parquet(written["model2_residuals"]).where("split = 'test'")
    rows = df.join(test.select(R.key, "predicted"), R.key).dropna(subset=[R.district, R.peak])
    again = model_load(written["model2"]).transform(rows)
    assert again.where(F.abs(F.col("prediction") - F.col("predicted")) > 1e-9).count() == 0
    assert lines.where("section = 'findings'").count() > 5


def test_far_columns_keep_their_digits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    df = spark.createDataFrame([(float(a + 1e9), float(b)) for a, b in x], "a double, b double")
    r = np.corrcoef(x.T)[0, 1]
    assert pca_fit(df, ["a", "b"]).eigenvalues == pytest.approx([1 + abs(r), 1 - abs(r)], abs=1e-6)
    assert dict(vif_table(df, ["a", "b"])) == pytest.approx({"a": 1 / (1 - r * r), "b": 1 / (1 - r * r)}, abs=1e-6)
    assert vif_table(df, ["a", "b"], max_cols=1) == []


def test_rare_class_is_a_clear_error(spark):
    df = spark.createDataFrame([(float(i), "x" if i < 3 else "y", i % 5) for i in range(200)], "a double, c string, f int")
    with pytest.raises(ValueError, match="fewer rows than there are folds"):
        forward_select_classification(df, ["a"], "c", ["x", "y"], F.col("f"))


def test_column_operators(spark):
    df = spark.createDataFrame([(1.0, 5.0, float("nan"), None), (2.0, 5.0, 3.0, None), (3.0, 5.0, float("inf"), None)], "a double, b double, c double, d double")
    kept, rows = near_constant_filter(df, ["a", "b", "d"])
    assert kept.columns == ["a", "c"] and [r[2] for r in rows] == [True, False, False]
    kept, rows = zero_variance_drop(df, ["a", "b", "d"])
    assert kept.columns == ["a", "c", "d"]
    assert [r.c for r in impute_mean(df, ["c"]).collect()] == [3.0, 3.0, 3.0]


def test_only_an_absent_result_table_is_empty(spark, tmp_path):
    assert scan_result_table(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "some").mkdir()
    with pytest.raises(RuntimeError):
        scan_result_table(spark, str(tmp_path / "some"), fmt="parquet")
