"""Finished stages of a flow, keyed by what they were made from.

A flow writes each result to its own folder under one shared folder and, when
the result is whole, an entry to the manifest beside them: the stage's name,
where it lies and a key. The key is a hash of the input (path, length and
modification time of every file, the plan over them, the schema) and of the
options. A stage whose entry has the same key is read instead of made, so a
flow that is started again after a lost driver goes on behind its last
finished stage; other data or options under the same paths give other keys
and are made anew. An entry appears by a rename, never half written.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import file_states, file_system
from ..sources.sinks import sink_table


def fingerprint_of_frame(df: DataFrame) -> str:
    """Hash of the files that a DataFrame reads, its plan and its schema."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    parts = [file_states(df.sparkSession, df.inputFiles()), re.sub(r"#\d+L?", "#", plan), df.schema.json()]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Manifest:
    """The finished stages of one flow in one folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.made: list[str] = []  # stages that this run has made
        self.paths: dict[str, str] = {}

    def _entry(self, name: str) -> str:
        return f"{self.folder}/_manifest/{name}.json"

    def finished(self, name: str) -> bool:
        fs, p = file_system(self.spark, self._entry(name))
        if not fs.exists(p):
            return False
        stream = fs.open(p)
        try:
            entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return entry["key"] == self.key and fs.exists(file_system(self.spark, entry["path"])[1])

    def _finish(self, name: str, path: str) -> None:
        fs, p = file_system(self.spark, self._entry(name))
        fs.mkdirs(p.getParent())
        _, half = file_system(self.spark, self._entry(name) + ".half")
        stream = fs.create(half, True)
        try:
            stream.write(json.dumps({"name": name, "key": self.key, "path": path}).encode())
        finally:
            stream.close()
        fs.delete(p, False)
        fs.rename(half, p)
        self.made.append(name)

    def stage(self, name: str, write: Callable[[str], object]) -> str:
        """The stage's path; ``write`` (given the path) makes it if needed."""
        path = f"{self.folder}/{name}"
        if not self.finished(name):
            write(path)
            self._finish(name, path)
        self.paths[name] = path
        return path

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``build`` is called only if it is not finished."""
        return self.spark.read.parquet(self.stage(name, lambda path: sink_table(build(), path)))
