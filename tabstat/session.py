"""Spark session helpers.

The engine never creates its own cluster settings beyond what a job needs:
AQE (with skew-join splitting) on, UTC session time zone, ANSI left as is.
The checkpoint folder is read from the session (``spark.checkpoint.dir``);
a local one is set only when the session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tabstat") -> SparkSession:
    """Session for tests and local benchmarks (UI off, no extra servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the job settings to an existing session (runtime SQL confs only)."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="tabstat-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


COMPILED_BYTES = "8000"  # methods beyond this many bytes of code are left uncompiled by the JVM


@contextmanager
def compiled_rows(spark: SparkSession) -> Iterator[None]:
    """For wide row work: a stage whose one generated method would be too
    large for the JVM to compile runs as one smaller piece per projection."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this application has written, once its
    results are no longer needed; returns how many there were."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the table to the shared checkpoint folder.

    Unlike ``localCheckpoint`` this survives executor loss: the data sit in
    the shared folder, and the returned DataFrame is a plain parquet scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
