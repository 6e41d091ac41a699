"""Operator 6: stupid-backoff language-model scores of a corpus by itself.

With c(.) counted over all documents, N words, and bigrams inside documents,
a word w after v scores c(v w) / c(v .) if the bigram occurs ``MIN_COUNT``
times or more, else ALPHA * c(w) / N; a document's first word scores c(w) / N.
A document's score is the sum of the logarithms.

1. Unigram counts: one aggregate on the word hash, a table partitioned by
   hash. Its most frequent words (``FREQUENT`` at most) go to every worker
   with their counts; their bigrams that are frequent within some batch are
   counted exactly in a second pass (``FREQUENT_PAIRS`` at most).
2. The other bigram occurrences are dealt by hash: by the first word, so that
   c(v .) is known where c(v w) is, or by the pair where the first word is a
   frequent one. A bucket is counted and joined with its own occurrences in
   one task; buckets hold about ``BUCKET`` occurrences at every size of the
   corpus, as the words and pairs that could fill one alone are not dealt.
3. Occurrences that back off to an infrequent word are joined with the
   unigram table; everything is summed per document.

Occurrences travel packed: the n-grams of some thousand documents that fall
into one bucket are one row of sorted, compressed arrays.

Cases: null and empty texts have no words and a null score; repeated rows are
counted as often as they occur and each gets its row; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import words as W

ALPHA = 0.4
MIN_COUNT = 2
FREQUENT = 500_000
FREQUENT_PAIRS = 65_536
BUCKET = 2_000_000
PACK_BYTES = 6 << 20  # text whose n-grams are packed together
_START = np.uint64(1 << 62)  # stands before a document's first word
_RARE = np.uint64(1 << 63)  # set in the code of an infrequent word
_PAIR = W.constants(2, 23)


def _packs(batches, text_at: int):
    """Word hashes of some texts at once: (rows, hashes, text number of each
    word, word range of each text)."""
    for batch in batches:
        rows, hashes, counts, size = None, [], [], 0
        first = 0
        for w in W.cut(batch.column(text_at)):
            hashes.append(w.hashes)
            counts.append(w.counts())
            size += len(w.data)
            if size >= PACK_BYTES or w.first + w.n == batch.num_rows:
                n = np.concatenate(counts)
                rows = batch.slice(first, len(n))
                yield rows, np.concatenate(hashes), np.repeat(np.arange(len(n)), n), np.concatenate(([0], np.cumsum(n)))
                first, hashes, counts, size = first + len(n), [], [], 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * _PAIR[0] + b * _PAIR[1])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, h, n, last) sums per pack: kind 0 words, with how often each is
    a document's last; kind 1 pairs that are frequent in the pack."""
    schema = "kind int, h bigint, n bigint, last bigint"

    def out(kind, h, n, last):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), _long(h), pa.array(n.astype(np.int64)), pa.array(last.astype(np.int64))],
                                          names=["kind", "h", "n", "last"])

    def run(batches):
        for _, h, doc, bounds in _packs(batches, 0):
            if not len(h):
                continue
            words, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            ends = bounds[1:][np.diff(bounds) > 0] - 1
            yield out(0, words, n, np.bincount(inverse[ends], minlength=len(words)))
            pairs, n = np.unique(_pair(h[:-1], h[1:])[doc[:-1] == doc[1:]], return_counts=True)
            often = n >= max(16, len(h) >> 14)
            yield out(1, pairs[often], n[often], n[often] * 0)

    return docs.select("text").mapInArrow(run, schema)


class Frequent:
    """Frequent words (sorted hashes, counts, counts as first of a pair) and
    frequent pairs (sorted hashes, counts)."""

    def __init__(self, words: pa.Table, pairs: pa.Table | None = None):
        def arrays(t):
            order = np.argsort(t.column("h").to_numpy().view(np.uint64))
            return [t.column(c).to_numpy().view(np.uint64)[order] if c == "h" else t.column(c).to_numpy()[order] for c in t.column_names]

        self.h, self.n, last = arrays(words.select(["h", "n", "last"]))
        self.first = self.n - last
        self.pairs, self.pair_n = arrays(pairs.select(["h", "n"])) if pairs is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return at, table[at] == h

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The place of a frequent word, else the hash with the top bit set."""
        at, known = self._find(self.h, h)
        return np.where(known, at.astype(np.uint64), h | _RARE)


def _pair_counts(docs: DataFrame, pairs) -> DataFrame:
    def run(batches):
        table = pairs.value
        total = np.zeros(len(table), np.int64)
        for _, h, doc, _ in _packs(batches, 0):
            at, known = Frequent._find(table, _pair(h[:-1], h[1:])[doc[:-1] == doc[1:]])
            total += np.bincount(at[known], minlength=len(table))
        has = np.flatnonzero(total)
        if len(has):
            yield pa.RecordBatch.from_arrays([_long(table[has]), pa.array(total[has])], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


_CODEC = "zstd"


def _pack(pack: int, ctx: np.ndarray, w: np.ndarray, doc: np.ndarray) -> bytes:
    """Occurrences of a pack, sorted by (ctx, w), with their text numbers."""
    raw = b"".join([np.diff(ctx, prepend=np.uint64(0)).tobytes(), w.tobytes(), doc.astype("<u2" if doc.max() < 65536 else "<u4").tobytes()])
    return np.array([pack, len(ctx), len(raw)], "<i8").tobytes() + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(blob: bytes):
    pack, n, size = np.frombuffer(blob, "<i8", 3).tolist()
    raw = pa.decompress(blob[24:], decompressed_size=size, codec=_CODEC, asbytes=True)
    ctx = np.cumsum(np.frombuffer(raw, "<u8", n), dtype=np.uint64)
    doc = np.frombuffer(raw, "<u2" if size == 18 * n else "<u4", n, 16 * n)
    return pack, ctx, np.frombuffer(raw, "<u8", n, 8 * n), doc


class Rows:
    """Record batches of the one schema that passes through the buckets: packed
    occurrences, documents, partial sums, occurrences of infrequent words."""

    def __init__(self, id_field: T.StructField, id_type: pa.DataType | None = None):
        simple = [("bucket", T.IntegerType(), pa.int32()), ("blob", T.BinaryType(), pa.binary()), ("pack", T.LongType(), pa.int64()), ("doc", T.IntegerType(), pa.int32()),
                  ("n_words", T.LongType(), pa.int64()), ("score", T.DoubleType(), pa.float64()), ("n_backoff", T.LongType(), pa.int64()),
                  ("w", T.LongType(), pa.int64()), ("first", T.BooleanType(), pa.bool_())]
        self.schema = T.StructType([T.StructField(n, t) for n, t, _ in simple] + [T.StructField("id", id_field.dataType)])
        self.names = self.schema.names
        self.types = [t for _, _, t in simple]

    def of(self, n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(self.names, [*self.types, id_type])], names=self.names)


def _deal(docs: DataFrame, rows: Rows, model, n_buckets: int, total: int) -> DataFrame:
    """Per pack: its documents with what the frequent tables decide, and a blob
    per bucket with the other occurrences. A pack is named by task and place,
    which a repeated task gives again."""

    def run(batches):
        from pyspark import TaskContext

        m: Frequent = model.value
        pack = TaskContext.get().partitionId() << 32
        for part, h, doc, bounds in _packs(batches, 1):
            pack += 1
            n = part.num_rows
            code = m.codes(h)
            begins = bounds[:-1][np.diff(bounds) > 0]
            second = np.ones(len(h), bool)
            second[begins] = False
            second = np.flatnonzero(second)
            ctx, w = code[second - 1], code[second]
            at, known = Frequent._find(m.pairs, _pair(h[second - 1], h[second]))
            known &= ctx < _START
            score = np.zeros(len(h))
            score[second[known]] = np.log(m.pair_n[at[known]]) - np.log(m.first[ctx[known].astype(np.int64)])
            common = begins[code[begins] < _START]
            score[common] = np.log(m.n[code[common].astype(np.int64)]) - math.log(total)
            ids = part.column(0)
            yield rows.of(n, ids.type, bucket=pa.array(np.full(n, pack % n_buckets, np.int32)), pack=pa.array(np.full(n, pack)), doc=pa.array(np.arange(n, dtype=np.int32)),
                          id=ids, n_words=pa.array(np.diff(bounds)), score=pa.array(np.bincount(doc, score, n)))
            rare = begins[code[begins] >= _START]
            ctx = np.concatenate([ctx[~known], np.full(len(rare), _START)])
            w = np.concatenate([w[~known], code[rare]])
            doc = np.concatenate([doc[second[~known]], doc[rare]])
            place = np.where(ctx >= _RARE, ctx, _pair(ctx, w))
            bucket = (W.mix(place) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((w, ctx, bucket))
            ctx, w, doc, bucket = ctx[order], w[order], doc[order], bucket[order]
            found, heads = np.unique(bucket, return_index=True)
            blobs = [_pack(pack, ctx[a:b], w[a:b], doc[a:b]) for a, b in zip(heads, np.append(heads[1:], len(bucket)))]
            yield rows.of(len(found), ids.type, bucket=pa.array(found.astype(np.int32)), blob=pa.array(blobs, pa.binary()))

    return docs.select("id", "text").mapInArrow(run, rows.schema)


_SUM = np.dtype([("doc", "<u4"), ("score", "<f8"), ("n_backoff", "<u4")])


def _solve(blobs: list[bytes], rows: Rows, id_type, m: Frequent, total: int, alpha: float, min_count: int):
    """Count a bucket's bigrams and score their occurrences."""
    parts = [_unpack(b) for b in blobs]
    of = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    packs = np.array([p[0] for p in parts])
    ctx, w, doc = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    del parts
    order = np.lexsort((w, ctx))
    ctx, w, doc, of = ctx[order], w[order], doc[order].astype(np.int64), of[order]
    new_ctx = np.concatenate(([True], ctx[1:] != ctx[:-1]))
    run = np.cumsum(new_ctx | np.concatenate(([True], w[1:] != w[:-1]))) - 1
    times = np.bincount(run)[run]
    of_ctx = np.cumsum(new_ctx) - 1
    first = np.bincount(of_ctx)[of_ctx]
    frequent = ctx < _START
    first[frequent] = m.first[ctx[frequent].astype(np.int64)]
    begin = ctx == _START
    used = (times >= min_count) & ~begin
    back = ~used & ~begin
    score = np.zeros(len(ctx))
    score[used] = np.log(times[used]) - np.log(first[used])
    known = back & (w < _START)
    score[known] = math.log(alpha) + np.log(m.n[w[known].astype(np.int64)]) - math.log(total)
    wide = int(doc.max()) + 1
    place = of * wide + doc
    seen = np.flatnonzero(np.bincount(place))
    sums = np.zeros(len(seen), _SUM)
    sums["doc"], sums["score"], sums["n_backoff"] = seen % wide, np.bincount(place, score)[seen], np.bincount(place, back)[seen]
    whose, heads = np.unique(seen // wide, return_index=True)
    blobs = [sums[a:b].tobytes() for a, b in zip(heads, np.append(heads[1:], len(seen)))]
    yield rows.of(len(whose), id_type, pack=pa.array(packs[whose]), blob=pa.array(blobs, pa.binary()))
    rest = np.flatnonzero((back | begin) & (w >= _START))
    if len(rest):
        yield rows.of(len(rest), id_type, pack=pa.array(packs[of[rest]]), doc=pa.array(doc[rest].astype(np.int32)), w=_long(w[rest]), first=pa.array(begin[rest]))


def _buckets(dealt: DataFrame, rows: Rows, model, total: int, alpha: float, min_count: int) -> DataFrame:
    def run(batches):
        bucket, blobs, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field("id").type
            whole = batch.column(1).is_null()
            if whole.true_count:
                yield batch.filter(whole)
            packed = batch.select([0, 1]).filter(batch.column(1).is_valid())
            for b, blob in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist()):
                if b != bucket and blobs:
                    yield from _solve(blobs, rows, id_type, model.value, total, alpha, min_count)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield from _solve(blobs, rows, id_type, model.value, total, alpha, min_count)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, rows.schema)


def _add_up(solved: DataFrame, rows: Rows) -> DataFrame:
    """(pack, doc, id, n_words, score, n_backoff): the documents of each pack
    with the sums of all buckets."""
    schema = T.StructType([f for f in rows.schema.fields if f.name in ("pack", "doc", "id", "n_words", "score", "n_backoff")])

    def run(batches):
        docs, sums = [], np.zeros(0, _SUM)

        def close():
            batch = pa.Table.from_batches(docs).combine_chunks().sort_by("doc").to_batches()[0]
            all_sums = np.zeros(batch.num_rows, _SUM)  # documents without a sum have zeros
            all_sums[: len(sums)] = sums
            total, back = batch.column(3).to_numpy() + all_sums["score"], all_sums["n_backoff"].astype(np.int64)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total), pa.array(back), batch.column(4)], names=schema.names)

        pack = None
        for batch in batches:
            names = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != pack:
                    if docs:
                        yield close()
                    pack, docs, sums = names[a], [], np.zeros(0, _SUM)
                part = batch.slice(a, b - a)
                docs.append(part.filter(part.column(5).is_null()).select([0, 1, 2, 3, 4]))
                for blob in part.column(5).drop_null().to_pylist():
                    more = np.frombuffer(blob, _SUM)
                    if more["doc"].max() >= len(sums):
                        sums = np.concatenate([sums, np.zeros(int(more["doc"].max()) + 1 - len(sums), _SUM)])
                    sums["score"][more["doc"]] += more["score"]
                    sums["n_backoff"][more["doc"]] += more["n_backoff"]
        if docs:
            yield close()

    rows_in = solved.where("w is null").select("pack", "doc", "n_words", "score", "id", "blob")
    return rows_in.repartition("pack").sortWithinPartitions("pack").mapInArrow(run, schema)


def _most_frequent(table: DataFrame, total: int, most: int) -> DataFrame:
    """The rows of the largest counts n, at most ``most``: those from the least
    count on that leaves no more."""
    steps = 65_536
    unit = 1 + total // (steps * most)
    sizes = table.groupBy(F.least(F.floor(F.col("n") / unit), F.lit(steps)).alias("step")).agg(F.count("*").alias("rows"))
    room, least = most, steps + 1
    for step, rows in sorted(((r["step"], r["rows"]) for r in sizes.collect()), reverse=True):  # steps + 1 rows at most
        if rows > room:
            break
        room, least = room - rows, step
    return table.where(F.col("n") >= max(1, least) * unit)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per document: id, n_words, n_backoff, log_prob."""
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    counts = materialize(_counts(slim).groupBy("kind", "h").agg(F.sum("n").alias("n"), F.sum("last").alias("last")), "ngram_counts")
    words, pairs = (counts.where(f"kind = {k}").select("h", "n", "last") for k in (0, 1))
    total = words.agg(F.sum("n")).first()[0] or 0
    table = np.sort(_most_frequent(pairs, total, FREQUENT_PAIRS).toArrow().column("h").to_numpy().view(np.uint64))
    pair_table = _pair_counts(slim, sc.broadcast(table)).toArrow() if len(table) else None
    model = sc.broadcast(Frequent(_most_frequent(words, total, FREQUENT).toArrow(), pair_table))

    rows, total = Rows(slim.schema["id"]), max(total, 1)
    dealt = _deal(slim, rows, model, max(1, math.ceil(total / BUCKET)), total)
    solved = materialize(_buckets(dealt, rows, model, total, alpha, min_count), "solved")
    key = ["pack", "doc"]
    rest = solved.where("w is not null").groupBy("w", *key, "first").agg(F.count("*").alias("times"))
    rare = words.select(F.col("h").bitwiseOR(F.lit(-(1 << 63))).alias("w"), "n")
    share = F.log("n") - math.log(total) + F.when(F.col("first"), 0.0).otherwise(math.log(alpha))
    rest = rest.join(rare, "w").select(*key, (share * F.col("times")).alias("score"))
    rest = rest.groupBy(*key).agg(F.sum("score").alias("more"))
    out = _add_up(solved, rows).join(rest, key, "left")
    log_prob = F.when(F.col("n_words") > 0, F.col("score") + F.coalesce("more", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_backoff", log_prob.alias("log_prob"))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_prob", 6).alias("log_prob"), F.round(F.col("log_prob") / F.col("n_words"), 6).alias("mean_log_prob"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
f AS (SELECT v, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v),
b AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.r, CASE WHEN t.v IS NULL THEN ln(u.c) - ln(n.n) WHEN b.c >= 2 THEN ln(b.c) - ln(f.c) ELSE ln(0.4) + ln(u.c) - ln(n.n) END AS x,
  t.v IS NOT NULL AND b.c < 2 AS back
  FROM t CROSS JOIN n JOIN u ON u.w = t.w LEFT JOIN f ON f.v = t.v LEFT JOIN b ON b.v = t.v AND b.w = t.w),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE back) AS n_backoff, sum(x) AS lp FROM s GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(lp, 6) AS log_prob, round(lp / n_words, 6) AS mean_log_prob
FROM d LEFT JOIN g ON g.r = d.r
"""
