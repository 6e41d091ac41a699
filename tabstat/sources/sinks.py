"""Sinks: result tables, the feature matrix, text lines and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def sink_feature_matrix(parts: list[tuple[str, DataFrame]], names: list[str], key: str, path: str) -> str:
    """One wide table: key, split, one double per feature; empty parts are
    skipped, all empty is an error. Written partitioned by split."""
    frames = []
    for split, df in parts:
        if df.limit(1).count() == 0:
            continue
        frames.append(df.select(F.col(f"`{key}`"), F.lit(split).alias("split"), *[F.col(f"`{c}`") for c in names]))
    if not frames:
        raise ValueError("no feature matrix to export")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return sink_table(out, path, partition_by=["split"])


def sink_text(spark: SparkSession, lines: list[str], path: str, section: str = "text") -> str:
    """Summary lines as a (section, line_no, text) table; order kept by line_no."""
    df = spark.createDataFrame([(section, i + 1, t) for i, t in enumerate(lines)], "section string, line_no int, text string")
    return sink_table(df, path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_store(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def model_load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
