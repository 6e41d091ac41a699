"""CSV scans: the observation file and stored result tables.

Every column is read as text (no ``inferSchema``: no extra pass and a schema
that does not change between files); typing happens later by expression.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing_tokens_to_null

# The missing-value words a CSV reader of the reference's
# tooling treats as missing by default.
DEFAULT_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def scan_csv(spark: SparkSession, path: str, missing_tokens=DEFAULT_MISSING_TOKENS) -> DataFrame:
    """UTF-8, comma separated, header line, blanks after the separator
    skipped; missing words become NULL. A missing path raises
    FileNotFoundError, other read errors RuntimeError."""
    try:
        df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", sep=",",
                            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False)
        cols = df.columns
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise FileNotFoundError(path) from exc
        raise RuntimeError(f"cannot read {path}: {exc}") from exc
    return df.select(*[missing_tokens_to_null(F.col(f"`{c}`"), missing_tokens).alias(c) for c in cols])


def scan_result_table(spark: SparkSession, path: str, columns: list[str] | None = None, head: int | None = None,
                      round_map: dict[str, int] | None = None, order_by: list[str] | None = None,
                      fmt: str = "csv") -> DataFrame:
    """Read a stored result table: absent path -> empty table; keep the
    requested columns that exist; first ``head`` rows in ``order_by`` order;
    per-column rounding of numeric columns."""
    try:
        if fmt == "csv":
            df = spark.read.csv(path, header=True, inferSchema=True)
        else:
            df = spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise RuntimeError(f"cannot read {path}: {exc}") from exc
        return spark.createDataFrame([], "value string")
    if columns:
        avail = [c for c in columns if c in df.columns]
        if avail:
            df = df.select(*[F.col(f"`{c}`") for c in avail])
    if head is not None:
        if order_by:
            df = df.orderBy(*[F.col(f"`{c}`") for c in order_by if c in df.columns])
        df = df.limit(head)
    if round_map:
        from ..functions.present import round_columns

        df = round_columns(df, round_map)
    return df
