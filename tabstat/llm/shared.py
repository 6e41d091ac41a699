"""Helpers shared by the operators: row identity, size-checked broadcasts,
connected components, slices of text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BROADCAST_BYTES = 64 << 20  # largest table that is sent to every executor


def identity(id_col: Column, text: Column) -> list[Column]:
    """96 bits that name a row by id and text; never null. Rows that repeat
    both are the same document."""
    return [F.xxhash64(id_col, text).alias("k1"), F.hash(text, id_col).alias("k2")]


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, with the broadcast hint if its counted rows prove it
    small; beyond the bound the join shuffles."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def sized_by(table: DataFrame, row_bytes: Column) -> DataFrame:
    """``sized`` for a written table whose rows differ in size: the bytes of
    the rows are summed."""
    total = table.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list: (node, root), root the least node
    of the component; nodes without an edge are absent.

    Alternating large-star and small-star steps: each is an aggregate and a
    join on the node, so a hub with very many edges is pre-aggregated and its
    join can be split. Every round is written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "components")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least).where("u <> v").distinct(), "components")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def text_slices(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text in column ``at``;
    a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j
