"""A flow goes on behind its last finished stage; other data or options make
all stages anew; caches follow the files, not their path."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tabstat.config import ModelOptions, Roles
from tabstat.plans import run_all as flow
from tabstat.plans.manifest import Manifest, fingerprint_of_frame
from tabstat.plans.q_rows import _obs
from tabstat.plans.registry import obs, q_group_summary
from tabstat.sources.files import file_states
from tests.conftest import SF001

R = Roles()
TABLES = ("events", "customer", "nation")


def _times(spark, written):
    return {n: max(t for _, _, t in file_states(spark, [p])) for n, p in written.items()}


def test_flow_resumes_after_a_lost_driver(spark, tmp_path, monkeypatch):
    df, _ = _obs(spark, SF001)
    options = ModelOptions(max_selected=2, point_limit=50, grid_bins=10)
    out = str(tmp_path / "flow")

    def lost(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(flow, "run_regression", lost)
        with pytest.raises(KeyboardInterrupt):
            flow.run_all(spark, df, out, options, R)
    before = {n: max(t for _, _, t in file_states(spark, [f"{out}/{n}"])) for n in ("numeric_summary", "density_grid", "qq_points", "pca_variance")}
    assert not os.path.exists(f"{out}/metrics")

    def again(*a, **k):
        raise AssertionError("a finished stage was made again")

    with monkeypatch.context() as m:
        for name in ("numeric_summary", "density_grid", "histogram_bins", "correlation_long"):
            m.setattr(flow.prof, name, again)
        lines, written = flow.run_all(spark, df, out, options, R)
    after = _times(spark, written)
    assert {n: after[n] for n in before} == before
    assert {"report_tables", "model1_residual_grid", "model2_actual_grid", "model1_diagnostics_text", "density_grid", "findings"} <= set(written)
    assert spark.read.parquet(written["qq_points"]).count() == 50
    assert spark.read.parquet(written["model1_residual_grid"]).agg(F.sum("count")).first()[0] == spark.read.parquet(written["model1_residuals"]).where("split = 'train'").count()
    # a whole flow is read, not made; other options make it anew
    with monkeypatch.context() as m:
        m.setattr(flow, "run_regression", again)
        same, _ = flow.run_all(spark, df, out, options, R)
        assert same.collect() == lines.collect()
        with pytest.raises(AssertionError):
            flow.run_all(spark, df, out, ModelOptions(max_selected=1), R)
        with pytest.raises(AssertionError):
            flow.run_all(spark, df.where("obs_id % 2 = 0"), out, options, R)


def test_half_written_stages_are_not_finished(spark, tmp_path):
    m = Manifest(spark, str(tmp_path), "k1")

    def broken(path):
        os.makedirs(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        m.stage("a", broken)
    assert not m.finished("a")
    m.table("a", lambda: spark.range(3))
    assert m.finished("a") and m.made == ["a"]
    assert not Manifest(spark, str(tmp_path), "k2").finished("a")
    shutil.rmtree(tmp_path / "a")
    assert not m.finished("a")


def test_changed_files_never_give_old_rows(spark, tmp_path):
    for t in TABLES:
        shutil.copy(f"{SF001}/{t}.parquet", tmp_path)
    first = {r.district: r.n_segments for r in q_group_summary(spark, str(tmp_path)).collect()}
    kept = obs(spark, str(tmp_path)).inputFiles()
    assert obs(spark, str(tmp_path)).inputFiles() == kept  # unchanged files: the written table
    half = spark.read.parquet(f"{SF001}/events.parquet").where("event_id % 2 = 0").coalesce(1)
    half.write.parquet(str(tmp_path / "half"))
    os.remove(tmp_path / "events.parquet")
    os.rename(tmp_path / "half", tmp_path / "events.parquet")
    second = {r.district: r.n_segments for r in q_group_summary(spark, str(tmp_path)).collect()}
    assert sum(second.values()) < sum(first.values())
    assert sum(second.values()) == half.join(spark.read.parquet(f"{SF001}/customer.parquet"), F.col("user_id") == F.col("c_custkey")).count()


def test_fingerprint_of_a_frame(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    assert fingerprint_of_frame(read()) == fingerprint_of_frame(read())
    assert fingerprint_of_frame(read().where("id > 3")) != fingerprint_of_frame(read().where("id > 4"))
    a = fingerprint_of_frame(read())
    spark.range(11).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert fingerprint_of_frame(read()) != a
