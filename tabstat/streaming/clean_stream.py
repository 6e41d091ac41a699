"""Streaming form of the row-level cleaning.

The reference reads one file once; nothing stateful is needed. The cleaning
(text, numbers, dates, durations, peak, cyclic hour, label) holds no state,
so the same ``derive`` plan runs on a streaming DataFrame: new CSV files in a
folder are cleaned and appended to a parquet table, with progress kept in a
checkpoint under the shared checkpoint folder (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..config import PrepareOptions, Roles
from ..plans.prepare import derive
from ..session import scratch_path
from ..sources.csv import DEFAULT_MISSING_TOKENS
from ..functions.text import missing_tokens_to_null
from pyspark.sql import functions as F


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def stream_prepare(spark: SparkSession, input_dir: str, columns: list[str], output_path: str,
                   checkpoint: str | None = None, roles: Roles = Roles(), options: PrepareOptions = PrepareOptions(),
                   available_now: bool = True) -> StreamingQuery:
    """Start the cleaning stream: CSV files (all text columns) -> parquet."""
    raw = (spark.readStream.schema(text_schema(columns))
           .option("header", True).option("ignoreLeadingWhiteSpace", True).csv(input_dir))
    raw = raw.select(*[missing_tokens_to_null(F.col(f"`{c}`"), DEFAULT_MISSING_TOKENS).alias(c) for c in columns])
    cleaned = derive(raw, roles, options)
    writer = (cleaned.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output_path)
