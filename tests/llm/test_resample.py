"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabstat.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, max_n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_n, buckets=resample.BUCKETS):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t, max_n)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows, may = [], []
    for i, text in docs:
        words, found = runs(text, max_n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score))
        if len(words) >= 20:
            may.append((-score, i is not None, i or 0))
    drawn = sorted(may)[: 10 * len(may) // 100]
    ranks = {}
    for r, x in enumerate(drawn, 1):
        ranks.setdefault((x[2] if x[1] else None, -x[0]), []).append(r)
    return rows, ranks


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_equal_to_brute_force(spark, max_n):
    r = random.Random(max_n)
    words = ["Alpha", "beta", "été", "日本", "x1", "of", "the", "THE", "9", "ÀB"]
    docs = [(i, " ,".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(400)] + [(500, None), (501, ""), (502, "-- \x00\x7f!")]
    target = [" ".join(r.choice(words[:4]) for _ in range(30)) for _ in range(20)] + [None]
    rows, ranks = brute(docs, target, max_n)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = resample.importance(df, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n).collect()
    assert sorted((x.doc_id, x.n_features, x.weight, x.score) for x in got) == sorted(rows)
    assert {(x.doc_id, x.score): [x.rank] for x in got if x["rank"]} == ranks and ranks


def test_long_runs_stay_within_a_text():
    texts = pa.array(["a b c", None, "d", "a b", ""])
    owner, bucket, n_words = resample.features(texts, 3)
    assert n_words.tolist() == [3, 0, 1, 2, 0]
    assert np.bincount(owner, minlength=5).tolist() == [6, 0, 1, 3, 0]
    want = sorted(zlib.crc32(f) % resample.BUCKETS for f in (b"a", b"b", b"c", b"a b", b"b c", b"a b c"))
    assert sorted(bucket[owner == 0].tolist()) == want


def test_odd_rows(spark, odd_docs):
    target = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "item_id bigint, text string")
    out = resample.importance(odd_docs, target, share=50)
    assert out.count() == odd_docs.count()
    ranks = sorted(x["rank"] for x in out.collect() if x["rank"])
    n = sum(len(runs(x.text, 1)[0]) >= 20 for x in odd_docs.select("text").collect())
    assert ranks == list(range(1, n // 2 + 1))
    drawn = resample.resample(odd_docs, target, share=50)
    assert drawn.columns == odd_docs.columns and drawn.count() == n // 2
    assert resample.importance(odd_docs.limit(0), target).count() == 0
    assert resample.importance(odd_docs, target.limit(0)).count() == odd_docs.count()
    assert resample.resample(odd_docs.limit(0), target.limit(0)).count() == 0


def test_draws_favour_the_target(spark):
    r = random.Random(9)
    near, far = [f"n{i}" for i in range(50)], [f"f{i}" for i in range(50)]
    docs = [(i, " ".join(r.choice(near if i % 4 == 0 else far) for _ in range(60))) for i in range(800)]
    target = [(" ".join(r.choice(near) for _ in range(60)),) for _ in range(50)]
    out = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(target, "text string"))
    ids = [x.doc_id for x in out.collect()]
    assert len(ids) == 80 and sum(i % 4 == 0 for i in ids) > 60
