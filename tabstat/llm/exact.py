"""Operator 13: exact dedup by two-pass Bloom filtering.

Texts are equal when identical after deleting blanks (space, tab to carriage
return); they are compared by the SHA-256 of what is left.

1. One scan writes a digest row per document (id, code points, digest).
2. First pass: the digests' hashes are dealt to segments of the hash space.
   The owner of a segment fills a Bloom filter with them; a hash whose slots
   were all set before may be a repeat and goes into the segment's second
   filter, sized by what it holds. Within a map task a hash leaves twice at
   most per ``FLUSH`` rows, so a text that a third of all rows share is a few
   bytes for each task.
3. Second pass: every digest row is tested against the second filters. A row
   that is not in them is surely single and passes straight through. Only the
   others shuffle: counted by digest with partial aggregates, and joined back
   with their group. Groups of more than ``HOT_ROWS`` rows are joined by
   broadcast (their number is bounded by the rows over ``HOT_ROWS``).

The second filters are sent to the workers up to ``filter_bytes`` in all, by
their counted size; rows of segments beyond the bound all count as possible
repeats and shuffle, so the bound costs time only.

Cases: null and empty texts and texts of blanks are equal to each other; of
equal texts the one with the most code points stays, then the smallest id
(null last), then any one row, so that repeated rows leave one; an empty
table gives an empty result; ``drop_repeats`` keeps other columns whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .shared import BROADCAST_BYTES, sized, text_slices
from .words import constants

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4  # slots of a hash in a filter
SEGMENT_ROWS = 2_000_000  # rows of a segment; its first filter takes 8 to 16 slots a row
FLUSH = 1_000_000  # hashes that a map task gathers before it sends them on
HOT_ROWS = 100_000  # larger groups are joined by broadcast

_FACTORS = constants(SLOTS, 13)
_SEGMENT = constants(1, 14)[0]


def slots(hashes: np.ndarray, size: int) -> np.ndarray:
    """SLOTS places in a filter of ``size`` (a power of two) for each hash."""
    bits = np.uint64(64 - (size.bit_length() - 1))
    return ((hashes[:, None] * _FACTORS) >> bits).astype(np.int64) if size > 1 else np.zeros((len(hashes), SLOTS), np.int64)


def _size(rows: int, per_row: int) -> int:
    """Slots of a filter for so many rows: a power of two, 64 at least."""
    return 1 << max(6, math.ceil(math.log2(max(1, rows) * per_row)))


def _segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes * _SEGMENT >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _hashes(digests: pa.Array) -> np.ndarray:
    """The first 8 bytes of each digest."""
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(len(digests), 4)[:, 0].copy()


def digest_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, plus __chars (code points of the text) and
    __digest (SHA-256 of the text without blanks)."""
    rest = [c for c in docs.columns if c != text_col]
    slim = docs.select(*rest, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, len(rest), 4 << 20):
                texts = part.column(len(rest)).fill_null("")
                raw = texts.cast(pa.binary()).to_pylist()
                found = pa.array([hashlib.sha256(t.translate(None, BLANKS)).digest() for t in raw], pa.binary())
                chars = pc.cast(pc.utf8_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], chars, found], names=[*rest, "__chars", "__digest"])

    fields = [*[slim.schema[c] for c in rest], T.StructField("__chars", T.LongType()), T.StructField("__digest", T.BinaryType())]
    return slim.mapInArrow(run, T.StructType(fields))


class Sieve:
    """The two filters of one segment."""

    def __init__(self, rows: int):
        self.seen = np.zeros(_size(rows, 8), bool)
        self.again: list[np.ndarray] = []

    def add(self, hashes: np.ndarray) -> None:
        unique, times = np.unique(hashes, return_counts=True)
        at = slots(unique, len(self.seen))
        maybe = (times > 1) | self.seen[at].all(axis=1)
        self.seen[at] = True
        self.again.append(unique[maybe])

    def filter(self) -> bytes:
        """Bits of the second filter; empty if nothing may repeat."""
        found = np.unique(np.concatenate(self.again)) if self.again else np.zeros(0, np.uint64)
        if not len(found):
            return b""
        bits = np.zeros(_size(len(found), 12), bool)
        bits[slots(found, len(bits))] = True
        return np.packbits(bits).tobytes()


def repeat_filters(digests: DataFrame, rows: int, segments: int) -> DataFrame:
    """First pass over __digest: (segment, bits) of each segment."""

    def deal(batches):
        held, n = [], 0

        def send():
            unique, times = np.unique(np.concatenate(held), return_counts=True)
            out = np.concatenate([unique, unique[times > 1]])
            home = _segment_of(out, segments)
            order = np.argsort(home, kind="stable")
            out, home = out[order], home[order]
            cuts = np.flatnonzero(np.diff(home, prepend=-1))
            parts = [x.tobytes() for x in np.split(out, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(home[cuts], pa.int32()), pa.array(parts, pa.binary())], names=["segment", "hashes"])

        for batch in batches:
            if batch.num_rows:
                held.append(_hashes(batch.column(0)))
                n += batch.num_rows
            if n >= FLUSH:
                yield send()
                held, n = [], 0
        if n:
            yield send()

    def own(batches):
        sieves: dict[int, Sieve] = {}
        waiting: dict[int, list[bytes]] = {}
        size = 0

        def pour():
            for segment, parts in waiting.items():
                if segment not in sieves:
                    sieves[segment] = Sieve(-(-rows // segments))
                sieves[segment].add(np.frombuffer(b"".join(parts), "<u8"))
            waiting.clear()

        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(segment, []).append(raw)
                size += len(raw)
                if size > 8 << 20:
                    pour()
                    size = 0
        pour()
        for segment, sieve in sieves.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([sieve.filter()], pa.binary())], names=["segment", "bits"])

    dealt = digests.select("__digest").mapInArrow(deal, "segment int, hashes binary")
    return dealt.repartition(segments, "segment").mapInArrow(own, "segment int, bits binary")


@dataclass
class RepeatFilter:
    """The second filters of the segments below ``covered``."""

    sent: object  # broadcast: segment -> bits
    segments: int
    covered: int


def repeat_filter(digests: DataFrame, filter_bytes: int = BROADCAST_BYTES) -> RepeatFilter:
    """First pass over a written table with __digest."""
    spark = digests.sparkSession
    rows = digests.count()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 4096))
    segments = max(1, -(-rows // SEGMENT_ROWS), spread)
    filters = materialize(repeat_filters(digests, rows, segments), "filters")
    total = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    covered = segments if total <= filter_bytes else int(segments * filter_bytes / total)
    found = filters.where(F.col("segment") < covered).collect()  # filter_bytes in all
    return RepeatFilter(spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in found}), segments, covered)


def flag_repeats(digests: DataFrame, by: RepeatFilter) -> DataFrame:
    """Second pass: the rows plus __maybe, false only for rows whose __digest
    is surely single."""
    names, sent, segments, covered = digests.columns, by.sent, by.segments, by.covered

    def test(batches):
        bits = {s: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for s, b in sent.value.items() if b}
        for batch in batches:
            hashes = _hashes(batch.column(names.index("__digest")))
            home = _segment_of(hashes, segments)
            maybe = home >= covered
            order = np.argsort(home, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                if len(own) and (b := bits.get(int(home[own[0]]))) is not None:
                    maybe[own] = b[slots(hashes[own], len(b))].all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], names=[*names, "__maybe"])

    return digests.mapInArrow(test, T.StructType([*digests.schema.fields, T.StructField("__maybe", T.BooleanType())]))


def _best(id_col: str) -> Column:
    """Least for the row that stays."""
    return F.struct((-F.col("__chars")).alias("less"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__row").alias("row"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    digests = digest_rows(docs.select(F.col(id_col).alias("__id"), F.col(text_col)), text_col)
    digests = materialize(digests.withColumn("__row", F.monotonically_increasing_id()), "digests")
    flagged = materialize(flag_repeats(digests, repeat_filter(digests, filter_bytes)), "flagged")
    single = flagged.where("NOT __maybe").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "__digest")

    maybe = flagged.where("__maybe")
    groups = materialize(maybe.groupBy("__digest").agg(F.count("*").alias("group_size"), F.min(_best("__id")).alias("best")), "groups")
    out = [single]
    # at most 65,536 groups, however many rows there are
    hot_rows = max(HOT_ROWS, flagged.count() >> 16)
    hot = F.broadcast(groups.where(F.col("group_size") > hot_rows))
    verdict = [F.col("best.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("best.row")).alias("kept"), "__digest"]
    if groups.where(F.col("group_size") > hot_rows).limit(1).count():
        out.append(maybe.join(hot, "__digest").select("__id", *verdict))
        maybe = maybe.join(hot, "__digest", "left_anti")
    rest = sized(groups.where(F.col("group_size") <= hot_rows), 120)
    out.append(maybe.join(rest, "__digest").select("__id", *verdict))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they
    were. Rows that are surely single don't shuffle."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    digests = materialize(digest_rows(named.select("__id", "__text"), "__text"), "digests")
    by = repeat_filter(digests, filter_bytes)
    least = F.min(F.struct((-F.col("__chars")).alias("less"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id")))
    best = flag_repeats(digests, by).where("__maybe").groupBy("__digest").agg(least.alias("best"))
    best = materialize(best.select(F.col("__digest").alias("digest"), (-F.col("best.less")).alias("chars"), F.col("best.id").alias("id")), "groups")
    full = flag_repeats(digest_rows(named, "__text"), by)
    # the id is part of the key, so the rows of a large group are spread
    on = (F.col("__digest") == F.col("digest")) & (F.col("__chars") == F.col("chars")) & F.col("__id").eqNullSafe(F.col("id"))
    stay = full.where("__maybe").join(sized(best, 100), on, "left_semi").dropDuplicates(["__digest"])
    left = full.where("NOT __maybe").unionByName(stay)
    return left.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""
