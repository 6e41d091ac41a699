"""Global ranks and running sums with one shuffle of the rows.

``Window.orderBy`` with no ``partitionBy`` moves every row to one task. Here
the rows are dealt to ranges of their order (``repartitionByRange`` on the
columns themselves, so integers, text and timestamps keep their order),
sorted and scanned in the same stage, and written once to the shared folder
with what the scan carries: for ranks the place within the range (the low bits
of ``monotonically_increasing_id``), for running sums the sum so far. Each
range's total then gives the offset that later ranges carry in: a table with a
row per range (with groups: per range that goes on with an earlier range's
group), joined by broadcast. The rows never move again, and nothing but the
range table passes through one task.

Callers aggregate heavy ties (``groupBy(value)``) before ranking; where rows
are ranked one by one, the tiebreak is part of the range order, so one value
that a third of the rows hold is spread over ranges too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

RANGE, PLACE = "__range", "__place"
_PLACE_BITS = 33  # monotonically_increasing_id: partition above, row number below


def _sorted_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _group_starts(batch: pa.RecordBatch, groups: list[str]) -> np.ndarray:
    """True where a row's group differs from the row before (null equals null);
    the first row is left False."""
    new = np.zeros(batch.num_rows, bool)
    for g in groups:
        codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], groups: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Running sums of one sorted range, restarted where the group changes."""
    at = TaskContext.get().partitionId()
    last, carry = None, {c: 0 for c in sums}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _group_starts(batch, groups)
        key = [batch.column(g)[0].as_py() for g in groups]
        new[0] = key != last
        start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
        begun = np.logical_or.accumulate(new)  # rows before go on with the last batch's group
        out = []
        for c in sums:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            run = total - np.where(begun, total[start] - v[start], -carry[c])
            carry[c] = run[-1]
            out.append(pa.array(run, batch.column(c).type))
        last = [batch.column(g)[-1].as_py() for g in groups]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *out, pa.array(np.full(batch.num_rows, at), pa.int32())],
                                         names=[*names, *sums, RANGE])


def _offsets(df: DataFrame, totals: DataFrame, groups: list[str], sums: list[str]) -> tuple[DataFrame, dict]:
    """(RANGE, groups, offset per sum) of the ranges that carry a sum in, and
    without groups the grand totals."""
    schema = f"{RANGE} int, " + ", ".join(f"`__off{c}` {totals.schema[c].dataType.simpleString()}" for c in sums)
    if not groups:
        rows, before = [], {c: 0.0 if totals.schema[c].dataType == T.DoubleType() else 0 for c in sums}
        for r in sorted(totals.collect(), key=lambda r: r[RANGE]):  # a row per range
            rows.append((r[RANGE], *[before[c] for c in sums]))
            before = {c: before[c] + r[c] for c in sums}
        return df.sparkSession.createDataFrame(rows, schema), before
    before = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(RANGE), *[F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)],
                            *[F.sum(c).over(before).alias(f"__off{c}") for c in sums])
    # only the first group of a range can have begun before it
    return carried.where(F.col(f"__off{sums[0]}").isNotNull()), {}


def cumsum_and_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: list[str],
    descending: bool = False,
    tiebreak: list[str] | None = None,
    prefix: str = "cum_",
    group_cols: list[str] | None = None,
) -> tuple[DataFrame, dict]:
    """``global_cumsum`` and, without groups, the total of each sum column."""
    groups = list(group_cols or [])
    key = F.col(order_col)
    order = [key.desc() if descending else key.asc(), *[F.col(t).asc() for t in tiebreak or []]]
    kinds = {c: T.LongType() if isinstance(df.schema[c].dataType, T.IntegralType) else T.DoubleType() for c in sum_cols}
    sums = {f"__sum{i}": c for i, c in enumerate(sum_cols)}
    sums_of = [F.coalesce(F.col(c).cast(kinds[c]), F.lit(0).cast(kinds[c])).alias(s) for s, c in sums.items()]
    dealt = _sorted_ranges(df, [*[F.col(g).asc() for g in groups], *order]).select("*", *sums_of)
    names, columns = df.columns, list(sums)
    schema = T.StructType([*df.schema.fields, *[T.StructField(s, kinds[c]) for s, c in sums.items()], T.StructField(RANGE, T.IntegerType())])
    scanned = materialize(dealt.mapInArrow(lambda batches: _scan(batches, names, groups, columns), schema), "ranges")
    totals = scanned.groupBy(*groups, RANGE).agg(*[F.sum(F.col(c).cast(kinds[c])).alias(s) for s, c in sums.items()])
    offsets, grand = _offsets(df, totals, groups, columns)
    on = F.col(f"r.{RANGE}") == F.col(f"o.{RANGE}")
    for i, g in enumerate(groups):  # a null group is a group: compare null-safe
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"o.__group{i}"))
    out = scanned.alias("r").join(F.broadcast(offsets).alias("o"), on, "left")
    run = [(F.col(f"r.{s}") + F.coalesce(F.col(f"o.__off{s}"), F.lit(0).cast(kinds[c]))).alias(f"{prefix}{c}") for s, c in sums.items()]
    return out.select(*[F.col(f"r.`{c}`") for c in names], *run), {c: grand.get(s, 0) for s, c in sums.items()}


def global_cumsum(df: DataFrame, order_col: str, sum_cols: list[str], **options) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in the order of ``order_col``
    (then ``tiebreak``; ``descending``), restarted per ``group_cols``. Adds
    ``cum_<c>`` columns (another ``prefix`` on demand; null counts as 0);
    the input should hold one row per (group, order value), or a tiebreak
    that makes the order total."""
    return cumsum_and_totals(df, order_col, sum_cols, **options)[0]


def global_row_number(df: DataFrame, order_col: str, tiebreak: list[str] | None = None, name: str = "row_number") -> DataFrame:
    """1-based global row number ordered by ``order_col`` then ``tiebreak``.
    Rows that tie in all of these are numbered in any order."""
    tie = "__tie"
    order = [F.col(c).asc() for c in [order_col, *(tiebreak or []), tie]]
    placed = _sorted_ranges(df.withColumn(tie, F.monotonically_increasing_id()), order).withColumn(PLACE, F.monotonically_increasing_id())
    placed = materialize(placed.drop(tie), "ranges").withColumn(RANGE, F.shiftright(PLACE, _PLACE_BITS).cast("int"))
    totals = placed.groupBy(RANGE).agg(F.count("*").alias("n"))
    offsets, _ = _offsets(df, totals, [], ["n"])
    within = F.col(PLACE).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return placed.join(F.broadcast(offsets), RANGE).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__offn") + within).alias(name))


def grouped_row_number(df: DataFrame, order_col: str, group_cols: list[str], tiebreak: list[str] | None = None, name: str = "row_number") -> DataFrame:
    """1-based row number within each group (null is a group) ordered by
    ``order_col`` then ``tiebreak``, which together make the order total. The
    rows stay in the JVM: a group is one run of places in a range, so its first
    place and the group's rows in earlier ranges give the number."""
    order = [F.col(c).asc() for c in [*group_cols, order_col, *(tiebreak or [])]]
    placed = materialize(_sorted_ranges(df, order).withColumn(PLACE, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(RANGE, F.shiftright(PLACE, _PLACE_BITS).cast("int"))
    runs = placed.groupBy(*group_cols, RANGE).agg(F.min(PLACE).alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group_cols).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    runs = runs.select(F.col(RANGE), *[F.col(g).alias(f"__group{i}") for i, g in enumerate(group_cols)], shift.alias("__shift"))
    on = F.col(f"r.{RANGE}") == F.col(f"o.{RANGE}")
    for i, g in enumerate(group_cols):
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"o.__group{i}"))
    out = placed.alias("r").join(F.broadcast(runs).alias("o"), on)  # a row per range and group in it
    return out.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col(f"r.{PLACE}") + F.col("o.__shift")).alias(name))


def value_counts_ranked(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values with count, start rank (0-based) and end rank
    (exclusive) in ascending order; heavy ties collapse before ranking. Reads
    the written ranges, so callers may pass over it more than once."""
    vc = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    r = global_cumsum(vc, "value", ["cnt"])
    return r.select("value", "cnt", (F.col("cum_cnt") - F.col("cnt")).alias("start"), F.col("cum_cnt").alias("end"))


def expand_positions(ranked: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """One row per observation from (value, start, cnt): position 1..n.

    A value repeated very often is first split into chunks of ``chunk``
    positions (and the chunks spread over tasks), so no single task
    generates a hot value's rows alone."""
    chunks = ranked.select(
        "value", "start", "cnt",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / chunk))).alias("ch"),
    )
    chunks = chunks.repartition("value", "ch")
    lo = F.col("start") + F.col("ch") * chunk + 1
    hi = F.least(F.col("start") + (F.col("ch") + 1) * chunk, F.col("start") + F.col("cnt"))
    return chunks.select("value", F.explode(F.sequence(lo, hi)).alias("position"))


__all__ = [
    "cumsum_and_totals",
    "global_cumsum",
    "global_row_number",
    "grouped_row_number",
    "value_counts_ranked",
    "expand_positions",
]
