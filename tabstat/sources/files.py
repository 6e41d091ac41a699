"""States of input files, through the file systems that Spark reads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under the paths; an
    absent path has none."""
    found = []
    for path in paths:
        fs, p = file_system(spark, path)
        if not fs.exists(p):
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Hash of the files under the paths."""
    return hashlib.sha256(json.dumps(file_states(spark, list(paths))).encode()).hexdigest()
