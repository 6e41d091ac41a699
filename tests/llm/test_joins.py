"""Joins over documents against brute force in plain Python."""

import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabstat.llm import chains, line_dedup, ngram_join, quality, shared
from tests.llm.test_text import plain_words


def spread(rng, base, n, changes):
    """n near copies of a word list."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: rng.choices(vocab, k=n)
    texts = [" ".join(prose(rng.randint(1, 90))) for _ in range(120)]
    texts += spread(rng, prose(80), 60, 1) + spread(rng, prose(70), 25, 2) + spread(rng, prose(300), 12, 9)
    texts += [texts[3]] * 30 + [texts[130]] * 20 + ["hello there"] * 3
    rng.shuffle(texts)
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def grams(text, k=5):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_classes(corpus, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # 7: clusters are cut into many blocks
    texts, df = corpus
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    n = [sum(i in p for p in links) for i in range(len(texts))]
    out = {r.doc_id: r for r in ngram_join.jaccard_classes(df).collect()}
    assert [out[i].class_id for i in range(len(texts))] == classes_of(len(texts), links)
    assert [out[i].n_links for i in range(len(texts))] == n
    kept = {r.doc_id for r in ngram_join.keep_one(df).collect()}
    assert kept == set(classes_of(len(texts), links))


def test_jaccard_links_between_size_classes(spark, monkeypatch):
    """A cluster of nested sets over four size classes, in many small blocks:
    links between neighbouring classes count too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(40, 90)]
    sets = [grams(t) for t in texts]
    assert len({int(np.log(len(s)) / np.log(1.25 * 1.0001)) for s in sets}) >= 3
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    out = {r.doc_id: r for r in ngram_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [out[i].class_id for i in range(len(texts))] == classes_of(len(texts), links)
    assert [out[i].n_links for i in range(len(texts))] == [sum(i in p for p in links) for i in range(len(texts))]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert (1 - 0.8**rows) ** bands <= 1e-4 and bands <= 32
    assert ngram_join.choose_bands(0.8, 0.9999, rows + 1)[0] > 32


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 480)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    want = classes_of(480, links)
    assert got == {i: want[i] for i in {x for p in links for x in p if p[0] != p[1]}}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_line_dedup(docs, min_words=line_dedup.MIN_WORDS):
    """Numbers of the lines that go, by position in the list: exact repeats of
    any length, and edits among lines of min_words or more."""
    lines = [(d, i, ln.split()) for d, t in docs for i, ln in enumerate((t or "").split("\n")) if ln.split()]
    gone = [set() for _ in docs]
    for d, i, w in lines:
        if any((e, j) < (d, i) and (w == v or min(len(w), len(v)) >= min_words and distance_one(w, v)) for e, j, v in lines):
            gone[d].add(i)
    return gone


def line_docs(seed=9):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(6)] + ["Le", "le"]
    pool = [rng.choices(vocab, k=rng.choice([1, 2, *range(6, 15)])) for _ in range(40)]
    out = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, at = rng.choice("sid"), rng.randrange(len(w))
                w[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(vocab)]
            text.append(rng.choice([" ", "  ", "\t"]).join(w))
        out.append((d, "\n".join(text)))
    return out


def test_line_dedup(spark):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    gone = plain_line_dedup(docs)
    assert sum(map(len, gone)) > 30
    found = {r.id: set(r.removed) for r in line_dedup.duplicate_lines(df).collect()}
    assert [found.get(d, set()) for d, _ in docs] == gone
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert texts == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_short_lines_repeat_exactly_only(spark):
    docs = [(0, "one two\none  two\r\none three\n\n \nx"), (1, "x\ny\none two\t"), (2, "a b c d e f g h\na b c d e f g i"), (3, "a b c d e f g")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for least in (8, 3):
        found = {r.id: r.removed for r in line_dedup.duplicate_lines(df, min_words=least).collect()}
        assert [set(found[d]) for d, _ in docs] == plain_line_dedup(docs, least)
    assert found == {0: [1], 1: [0, 2], 2: [1], 3: [0]}


def test_within_one(spark):
    rng = random.Random(1)
    rows = [(rng.choices("ab", k=rng.randint(0, 6)), rng.choices("ab", k=rng.randint(0, 6))) for _ in range(600)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", line_dedup.within_one("a", "b").alias("near")).collect():
        assert r.near == distance_one(list(r.a), list(r.b))


def plain_chain_score(pos, rpos):
    best = []
    for i in range(len(pos)):
        before = [best[j] - chains.GAP_COST * (pos[i] - pos[j] + rpos[i] - rpos[j]) for j in range(i) if pos[j] < pos[i] and rpos[j] < rpos[i]]
        best.append(chains.SEED + max([0.0, *before]))
    return max(best)


def test_chains_are_best():
    rng = random.Random(4)
    for _ in range(200):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))})
        pos, rpos = (np.array(x) for x in zip(*anchors))
        got = chains.chain(pos, rpos)
        assert sorted(x for c in got for x in c) == list(range(len(pos)))
        c = got[0]
        assert all(pos[a] < pos[b] and rpos[a] < rpos[b] for a, b in zip(c, c[1:]))
        cost = sum(chains.GAP_COST * (pos[b] - pos[a] + rpos[b] - rpos[a]) for a, b in zip(c, c[1:]))
        assert len(c) * chains.SEED - cost == pytest.approx(plain_chain_score(pos, rpos))


def test_planted_passages(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    fuzzy = rng.choices(vocab, k=120)
    rows, spans = [], {}
    for d in range(80):
        before, after = rng.choices(vocab, k=rng.randint(0, 80)), rng.choices(vocab, k=rng.randint(0, 80))
        middle = []
        if d % 4 == 0:
            middle = passage
        elif d % 4 == 1:
            middle = list(fuzzy)
            for at in range(rng.randint(20, 29), 105, 30):  # the ends stay as they are, so that they can be found
                if rng.random() < 0.5:
                    middle[at] = "changed%d" % rng.randrange(10**6)
                else:
                    del middle[at]
        rows.append((d, " ".join(before + middle + after)))
        spans[d] = (len(before), len(before) + len(middle)) if middle else None
    rows.append((80, rows[0][1]))
    out = {r.doc_id: r for r in chains.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d in range(80):
        r = out[d]
        if spans[d] is None:
            assert (r.n_passages, r.class_id, r.n_later) == (0, d, 0)
        elif d < 2:
            assert r.n_passages == 0 and r.n_later > 0 and r.class_id == d
        else:
            assert r.class_id == d % 4
            assert len(r.passages) == 1
            assert abs(r.passages[0].start - spans[d][0]) <= 2 and abs(r.passages[0].end - spans[d][1]) <= 2
    assert [(p.start, p.end, p.sources) for p in out[80].passages] == [(0, len(rows[0][1].split()), [0])]


def planted_pairs(rng, vocab, edits):
    """Texts in pairs: the second has the first's passage of m words, of which
    e inside are changed; {(m, e): pairs}. Numbers of the second texts by case."""
    texts, seconds = [], {}
    for (m, e), n in edits.items():
        for _ in range(n):
            passage = rng.choices(vocab, k=m)
            near = list(passage)
            for at in rng.sample(range(1, m - 1), e):
                near[at] = f"x{rng.randrange(10**6)}"
            for x in (passage, near):
                texts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 70)) + x + rng.choices(vocab, k=rng.randint(0, 70))))
            seconds.setdefault((m, e), []).append(len(texts) - 1)
    return texts, seconds


def test_recall_of_fuzzy_passages(spark):
    """Changes anywhere but on the first and last word: similarity 0.8 to 0.95
    at 50 to 60 words is found, one source."""
    edits = {(50, 2): 20, (50, 4): 20, (50, 8): 30, (50, 10): 60, (60, 6): 20, (60, 12): 40}
    texts, seconds = planted_pairs(random.Random(3), [f"w{i}" for i in range(3000)], edits)
    out = {r.doc_id: r for r in chains.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for case, numbers in seconds.items():
        found = [d for d in numbers if [p.sources for p in out[d].passages or []] == [[d - 1]]]
        assert len(found) >= 0.97 * len(numbers), case
    assert sum(r.n_passages for r in out.values()) == sum(len(out[d].passages or []) for x in seconds.values() for d in x)


def test_short_phrases_make_no_passage(spark):
    """A text of phrases of 7 words, each from another document."""
    rng = random.Random(2)
    phrases = [rng.choices([f"w{i}" for i in range(3000)], k=7) for _ in range(20)]
    texts = [" ".join(rng.choices([f"v{i}" for i in range(3000)], k=30) + p) for p in phrases] + [" ".join(sum(phrases, []))]
    assert all(r.n_passages == 0 for r in chains.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())


def test_anchors_of_many_ranges(spark):
    """Each seed meets the first document that has it and the one before its
    own, wherever the ranges of the seeds are cut."""
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, 7, rng.randrange(1000)]), None if d == 5 else d // 2, d * 77, d, p) for d in range(150) for p in range(rng.randint(1, 9))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(before, ("12", "false", "40")):
        spark.conf.set(k, v)
    try:
        got = [tuple(r) for r in chains.anchors(spark.createDataFrame(rows, "h bigint, id bigint, k1 bigint, k2 int, pos int")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, seen = [], {}
    for h, i, k1, k2, pos in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:])):
        known = seen.setdefault(h, [])  # first place of h in each document so far
        if not known or known[-1][1] != k1:
            known.append((i, k1, k2, pos))
        others = known[:-1]
        for source in sorted({0, len(others) - 1}) if others else []:
            want.append((i, k1, k2, *others[source][:3], pos, others[source][3], source == 0))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_passage_whose_seeds_stand_in_earlier_documents(spark):
    """Every seed of the passage is in an earlier document of 7 words, too
    short to be its source."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    texts, copies = [], []
    for _ in range(10):
        passage = rng.choices(vocab, k=60)
        texts += [" ".join(passage[i : i + 7]) for i in range(0, 54, 3)] + [" ".join(passage[-7:])]
        for _ in range(2):
            texts.append(" ".join(rng.choices(vocab, k=40) + passage + rng.choices(vocab, k=40)))
        copies.append(len(texts) - 1)
    out = {r.doc_id: r for r in chains.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [[p.sources for p in out[d].passages or []] for d in copies] == [[[d - 1]] for d in copies]


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 700), (3, 2000), (10, 5000), (90, 30_000), (35_000, 10_000_000), (5, 10), (0, 0)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", F.expr(quality.binomial_tail("k", "n", 0.004)).alias("p"))
    for r in df.collect():
        if r.n <= 30_000 and r.k < r.n * 0.004:
            exact = sum(comb(r.n, i) * 0.004**i * 0.996 ** (r.n - i) for i in range(r.k + 1)) if r.n <= 5000 else None
            if exact is not None:
                assert r.p == pytest.approx(exact, rel=1e-9)
        assert 0 <= r.p <= 1
        assert r.k < r.n * 0.004 or r.p == 1


def test_cutoffs_hold_the_limit(spark):
    rng = random.Random(6)
    rows, labs = [], []
    for d in range(9000):
        good, lang = d % 3 > 0, "ab"[d % 2]
        w = [f"word{rng.randrange(500)}" for _ in range(30)]
        if not good:
            w = [x + rng.choice(["##", "", "$"]) for x in w]
        elif rng.random() < 0.0005:
            w = [x + "#" for x in w]
        rows.append((d, " ".join(w), lang if d < 8900 else "rare"))
        labs.append((d, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = quality.quality_report(docs, spark.createDataFrame(labs, "doc_id bigint, quality int")).collect()
    good = [r for r in out if r.doc_id % 3 and r.lang != "rare"]
    bad = [r for r in out if not r.doc_id % 3 and r.lang != "rare"]
    assert sum(not r.kept for r in good) <= quality.LIMIT * len(good)
    assert sum(not r.kept for r in bad) > 0.95 * len(bad)
    assert all(r.kept for r in out if r.lang == "rare")  # too few labels: no rule


def test_filter_by_codes_loses_no_stretch():
    """Chains that the codes rule out have no stretch that counts, whatever
    the words around them; a shared phrase alone is ruled out."""
    rng = random.Random(9)
    pairs, ruled_out, phrases = [], 0, 0
    for n in range(600):
        core = [rng.randrange(2**32) for _ in range(5)]
        vocab = [rng.randrange(2**32) for _ in range(rng.choice([3, 40, 10**5]))]
        sides = [rng.choices(vocab, k=rng.randint(0, 300)) for _ in range(2)]
        others = [list(x) for x in sides]
        for x in others:
            for _ in range(int(len(x) * rng.choice([0.05, 0.2, 0.3, 1]))):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choices(vocab, k=rng.choice([1, 1, 1, 0, 2]))
        cut = rng.randint(0, 9) if n % 3 else 300  # words that one side has at least
        a = np.array(sides[0] + core + sides[1], "<u4")
        b = np.array(others[0][-cut:] + core + others[1][:cut] if cut else core, "<u4")
        pairs.append(([[len(sides[0])]], [[len(b) - 5 - min(len(others[1]), cut) if cut else 0]], a.tobytes(), b.tobytes()))
    packed = []
    for i in (2, 3):
        words = [np.frombuffer(p[i], "<u4") & 15 for p in pairs]
        words = [np.append(x, [0] * (len(x) % 2)).astype(np.uint8) for x in words]
        packed.append(pa.array([(x[0::2] | x[1::2] << 4).tobytes() for x in words], pa.binary()))
    places = [pa.array([p[i] for p in pairs], pa.list_(pa.list_(pa.int32()))) for i in (0, 1)]
    low = np.zeros(len(pairs), np.int32)
    keep = chains.may_stand(*places, low, low, *packed, chains.MIN_WORDS, chains.SIMILARITY)
    at = chains.align_all(pairs)
    own, other = at[:, 1] - at[:, 0], at[:, 3] - at[:, 2]
    counts = (own >= chains.LEAST_STRETCH) & (at[:, 4] >= chains.SIMILARITY * np.maximum(own, other))
    assert counts.sum() > 100 and not (counts & ~keep).any()
    assert (~keep).sum() > 100


def test_pairs_of_one_phrase_are_not_aligned(spark, monkeypatch):
    """Word arrays go only to pairs that may have a stretch that counts."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30_000)]
    phrase = rng.choices(vocab, k=8)
    texts = [" ".join(rng.choices(vocab, k=100) + phrase + rng.choices(vocab, k=100)) for _ in range(30)]
    texts.append(texts[0])
    seen, plain = [], chains.stretches

    def stretches(found, *rest):
        seen.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(chains, "stretches", stretches)
    out = {r.doc_id: r for r in chains.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {d for d, r in out.items() if r.n_passages} == {30} and out[30].class_id == 0
    assert 1 <= seen[0] <= 3  # 59 pairs share the phrase
