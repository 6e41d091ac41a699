"""Operator 11: target-distribution importance resampling with Arrow kernels.

Features of a text are its runs of 1 to ``max_n`` words (A-Z lower-cased; a
word is a run of ASCII letters, digits and non-ASCII characters). A feature's
bucket is its crc32 modulo ``buckets``. A bucket that is more frequent in the
target than in the corpus has a positive gain, a document weighs the mean gain
of its features, and the documents with the highest weight plus Gumbel noise
are drawn: a sample without replacement in proportion to exp(weight / 1000).

1. Per slice of an Arrow batch: ``ascii_lower``, ``split_pattern_regex``,
   ``list_flatten`` and ``dictionary_encode`` turn texts into word indices;
   shifted indices form the longer runs, which are dictionary-encoded again.
   CRCs are taken once per distinct run, carried on from the shorter run.
2. One pass over corpus and target counts the buckets: a row per task and
   bucket, summed by ``groupBy``. The counts (``buckets`` numbers, whatever
   the corpus) give the gains.
3. A second pass takes each feature's gain and reduces them by document.
4. Scores are integers of a bounded range, so their counts are a small table
   that gives the score of the last drawn document. Rows below pass straight
   through; the rest are ranked by the one-shuffle global rank.

Cases: null and empty texts have no features and weight 0; a null id is hashed
as an empty one and comes first among ties; rows that repeat id and text get
the same score and ranks of their own; an empty target gives gains from the
corpus alone; empty tables give empty results; ``resample`` keeps other
columns whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import global_row_number
from ..session import materialize
from .shared import text_slices

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MIN_WORDS = 20  # shorter documents are not drawn
SHARE = 10  # per cent of the others that are drawn
SEED = "2024"
SCALE = 1000  # gains and noise are integers in units of 1 / SCALE


def word_indices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, index) of every word, and the distinct words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    return owner.filter(real).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def features(texts: pa.Array, max_n: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature, ordered by text, and the number
    of words of each text."""
    owner, word, distinct = word_indices(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    raw = distinct.cast(pa.binary()).to_pylist()
    crc = np.array([zlib.crc32(w) for w in raw], np.int64)  # of the distinct runs
    run, owners, found = word, [owner], [crc[word] % buckets if len(word) else word]
    for n in range(2, max_n + 1):
        # runs of n words: a run of n - 1 words and the word after it, of one text
        m = max(0, len(word) - n + 1)
        same = owner[:m] == owner[n - 1 :][:m]
        pairs = pa.array(run[:m] * len(raw) + word[n - 1 :][:m]).dictionary_encode()
        first, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(raw)))
        crc = np.array([zlib.crc32(b" " + raw[b], int(crc[a])) for a, b in zip(first, last)], np.int64)
        run = pairs.indices.to_numpy().astype(np.int64)
        owners.append(owner[:m][same])
        found.append(crc[run][same] % buckets)
    owners, found = np.concatenate(owners), np.concatenate(found)
    if max_n > 1:
        order = np.argsort(owners, kind="stable")
        owners, found = owners[order], found[order]
    return owners, found, n_words


def bucket_counts(table: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                total += np.bincount(features(part.column(0), max_n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = table.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed shares, in floored thousandths."""
    k = len(corpus)
    top = (target + 1).astype(float) * float(corpus.sum() + k)
    bottom = (corpus + 1).astype(float) * float(target.sum() + k)
    return np.floor(SCALE * np.log(top / bottom)).astype(np.int64)


def weigh(docs: DataFrame, by_bucket: np.ndarray, text_col: str = "text", max_n: int = 1) -> DataFrame:
    """docs without the text, plus __n_words, __n_features and __weight."""
    rest = [c for c in docs.columns if c != text_col]
    slim = docs.select(*rest, F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, len(rest)):
                owner, bucket, n_words = features(part.column(len(rest)), max_n, len(by_bucket))
                n = np.bincount(owner, minlength=part.num_rows)
                taken = np.concatenate(([0], np.cumsum(by_bucket.take(bucket))))
                ends = np.cumsum(n)
                weight = (taken[ends] - taken[ends - n]) // np.maximum(n, 1)
                new = [pa.array(x.astype(np.int64), pa.int64()) for x in (n_words, n, weight)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*rest, "__n_words", "__n_features", "__weight"])

    fields = [*[slim.schema[c] for c in rest], *[T.StructField(c, T.LongType()) for c in ("__n_words", "__n_features", "__weight")]]
    return slim.mapInArrow(run, T.StructType(fields))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
               max_n: int = 1, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """docs without the text, plus n_features, weight, score and rank (from 1
    in the order of the draw; null if not drawn). Columns of docs that are
    called like these give way."""
    by_bucket = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    own = {"n_features", "weight", "score", "rank"}
    rest = [c for c in docs.columns if c != text_col and c not in own - {id_col}]
    weighed = weigh(docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col)), by_bucket, text_col, max_n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("__score", F.col("__weight") + noise)
    scored = materialize(scored.withColumn("__may", F.col("__n_words") >= min_words), "scored")

    # scores are integers between the least and largest sum of gain and noise
    by_score = scored.where("__may").groupBy("__score").count().collect()
    n = sum(r["count"] for r in by_score)
    drawn, left, cut = share * n // 100, share * n // 100, None
    for r in sorted(by_score, key=lambda r: -r["__score"]):
        if left <= 0:
            break
        cut, left = r["__score"], left - r["count"]
    high = F.col("__may") & (F.col("__score") >= F.lit(cut)) if cut is not None else F.lit(False)
    order = scored.where(high).withColumn("__less", -F.col("__score"))
    ranked = global_row_number(order, "__less", tiebreak=[id_col], name="__rank").drop("__less")
    ranked = ranked.withColumn("__rank", F.when(F.col("__rank") <= drawn, F.col("__rank")))
    every = ranked.unionByName(scored.where(~high).withColumn("__rank", F.lit(None).cast("long")))
    return every.select(*[F.col(f"`{c}`") for c in rest], F.col("__n_features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = importance(packed, target, "__id", "__text", **options).where("rank IS NOT NULL")
    return found.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance(docs.select("doc_id", "text"), target)


# crc32 by its 256-entry table, itself made of eight shifts of each byte.
ORACLE = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
             FROM (SELECT unnest(range(256)) AS i)),
w AS (SELECT 0 AS target, rid, unnest(regexp_extract_all(replace_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
      FROM (SELECT rowid_ AS rid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS replace_az FROM (SELECT row_number() OVER () AS rowid_, text FROM documents))
      UNION ALL
      SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM w)),
coded AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS b FROM words, crc),
n AS (SELECT b, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t FROM w JOIN coded USING (w) GROUP BY b),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(n.t + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE)) / (CAST(n.s + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM n, total),
d AS (SELECT row_number() OVER () AS rid, doc_id FROM documents),
f AS (SELECT rid, count(*) AS n_features, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM w JOIN coded USING (w) JOIN gain USING (b) WHERE target = 0 GROUP BY rid),
h AS (SELECT rid, doc_id, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM d),
scored AS (SELECT doc_id, rid, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN f USING (rid)),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.r <= 10 * r.n // 100 THEN r.r END AS rank FROM scored s LEFT JOIN ranked r USING (rid)
"""
