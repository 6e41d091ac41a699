"""Exact dedup: filters, groups against plain Python, odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tabstat.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((i, t or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(own), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return sorted(out, key=repr)


def test_filters_miss_no_repeat_and_pass_few_single_hashes():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    sieve = exact.Sieve(50_000)
    for part in np.array_split(np.concatenate([h, h[:5000]]), 7):
        sieve.add(part)
    bits = np.unpackbits(np.frombuffer(sieve.filter(), np.uint8)).astype(bool)
    hit = bits[exact.slots(h, len(bits))].all(axis=1)
    assert hit[:5000].all()
    assert hit[5000:].mean() < 0.05


@pytest.mark.parametrize("filter_bytes", [64 << 20, 200, 0])
def test_groups_equal_brute_force(spark, filter_bytes):
    r = random.Random(5)
    words = ["a", "é", "b\t", "  ", "\n", "日本", "c"]
    rows = [(i, "".join(r.choice(words) for _ in range(r.randrange(6)))) for i in range(600)]
    rows += [(1000 + i, f"hot text{' ' * (i % 5)}") for i in range(500)] + [(None, "hot  text"), (2000, None), (2001, "x" * 200_000), (2002, "x" * 200_000 + "\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = exact.exact_groups(df, filter_bytes=filter_bytes).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got], key=repr) == brute(rows)
    assert all(x.kept == (x.doc_id == x.keep_id) for x in got)
    kept = exact.drop_repeats(df, filter_bytes=filter_bytes).collect()
    assert sorted((x.doc_id for x in kept), key=repr) == sorted((x.doc_id for x in got if x.kept), key=repr)


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 20)
    rows = [(i, "same" if i % 3 else f"t{i // 6}") for i in range(300)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got], key=repr) == brute(rows)
    assert sum(x.kept for x in got) == 51


def test_odd_rows(odd_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    got = exact.exact_groups(odd_docs).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got], key=repr) == brute(rows)
    assert sum(x.kept for x in got) == len({x.text_sha256 for x in got})  # repeated rows leave one
    out = exact.drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == len({x.text_sha256 for x in got})
    assert exact.exact_groups(odd_docs.limit(0)).count() == 0
    assert exact.drop_repeats(odd_docs.limit(0)).count() == 0


def test_bloom_pass_keeps_single_rows_out_of_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5000)] + [(9000 + i, "text 1") for i in range(50)], "doc_id bigint, text string")
    digests = exact.digest_rows(df).cache()
    flagged = exact.flag_repeats(digests, exact.repeat_filter(digests))
    maybe = flagged.where("__maybe")
    assert 51 <= maybe.count() < 51 + 0.05 * 5000
    assert maybe.where("doc_id = 1 OR doc_id >= 9000").count() == 51
    digests.unpersist()
