"""The semi-Markov field against enumeration, its sample and its recall."""

import random
from itertools import product

import numpy as np
import pytest

from tabstat.llm import pii


def segmentations(places, n):
    """Every set of segments that do not overlap, as lists of numbers."""
    if n <= 0:
        return [[]]
    out = list(segmentations(places, n - 1))
    for c, (i, j, _, _) in enumerate(places):
        if j == n:
            out += [s + [c] for s in segmentations(places, i)]
    return out


def small_islands():
    texts = ["call 555 123 4567 now", "mail bob at home dot org or 12.34.56.78", "x 1234 5678 9012 3456 y", "(555) 123-4567 and 10.0.0.1", "ann [at] web.de"]
    found = [island for t in texts for island in pii.islands(t) if 0 < len(island.places) <= 40 and island.n <= 12]
    assert len(found) >= 4
    return found


def field_for(island, seed):
    rng = random.Random(seed)
    names = sorted({f for feats in island.features for f in feats})
    return pii.Field({f: [rng.uniform(-1.5, 1.5) for _ in pii.KINDS] for f in names})


@pytest.mark.parametrize("seed", range(5))
def test_best_path_and_marginals_equal_enumeration(seed):
    for island in small_islands():
        field = field_for(island, seed)
        scores = field.scores(island)
        paths = segmentations(island.places, island.n)
        best = max(sum(scores[c].max() for c in p) for p in paths)
        got = field.decode(island)
        places = {(a, b): c for c, (_, _, a, b) in enumerate(island.places)}
        assert sum(scores[places[a, b]][pii.KINDS.index(k)] for k, a, b in got) == pytest.approx(best, abs=1e-9)
        total = np.logaddexp.reduce(scores, axis=1)
        weight = np.array([np.exp(sum(total[c] for c in p)) for p in paths])
        want = [sum(w for w, p in zip(weight, paths) if c in p) / weight.sum() for c in range(len(island.places))]
        assert pii._marginals(island, total) == pytest.approx(want, abs=1e-9)


def people(seed, n):
    """Sentences with personal data in the base forms."""
    r = random.Random(seed)
    words = "the office of our team can be reached under this old number or name every day".split()
    out = []
    for _ in range(n):
        card = [r.randrange(10) for _ in range(15)]
        check = next(d for d in range(10) if pii.luhn("".join(map(str, [*card, d]))))
        card = "".join(map(str, [*card, check]))
        values = [f"{r.choice('abcde')}{r.choice(['nn', 'ob', 'eve'])}{r.randrange(100)}@{r.choice(['mail', 'post-box', 'web'])}.{r.choice(['org', 'de', 'co.uk'])}",
                  f"+1 {r.randrange(200, 999)} {r.randrange(200, 999)} {r.randrange(1000, 9999)}",
                  " ".join(card[i : i + 4] for i in range(0, 16, 4)), ".".join(str(r.randrange(256)) for _ in range(4))]
        r.shuffle(values)
        out.append(" ".join(" ".join(r.choices(words, k=r.randint(4, 9))) + " " + v for v in values) + " and so on")
    return out


def test_recall_of_held_out_rewritten_values(spark):
    """Values of other people, in forms that the fixed patterns miss."""
    docs = spark.createDataFrame(list(enumerate(people(1, 120))), "doc_id bigint, text string")
    field = pii.fit(docs)
    hit = asked = wrong = plain = 0
    r = random.Random(3)
    for text in people(2, 60):
        for kind, a, b in pii.base_spans(text):
            for other in pii.variants(kind, text[a:b]):
                before, after = text[max(0, a - 30) : a], " and more words follow"
                line = before.split(" ", 1)[-1] + other + after
                start = len(line) - len(after) - len(other)
                asked += 1
                hit += any(k == kind and max(s, start) < min(e, start + len(other)) and (e - s) >= 0.7 * len(other)
                           for k, s, e, base in pii.find_spans(line, field))
        clean = f"in {r.randrange(1800, 2030)} there were {r.randrange(10, 99)},{r.randrange(100, 999)} people and {r.random():.4f} of them stayed"
        plain += 1
        wrong += bool(pii.find_spans(clean, field))
    assert asked > 300 and hit >= 0.9 * asked
    assert wrong <= 0.05 * plain


def test_sample_is_bounded_and_has_every_kind(spark):
    many = " ".join(f"user{i}@mail{i}.org" for i in range(300)) + " call +1 555 123 4567 or 10.1.2.3"
    kinds = [k for _, g in pii.examples_of(many, pii.EXAMPLES) for k, _, _ in g]
    assert {"phone", "ip", "email"} <= set(kinds)
    assert len(pii.examples_of(many, 2)) <= 2 * 4 * len(pii.KINDS)
    rows = [(i, f"write to a{i}@b.org") for i in range(300)] + [(7, "write to a7@b.org")] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = pii.sample(df, n=40).collect()
    assert 0 < len(got) <= 40 and len({r.text for r in got}) == len(got)
    assert pii.sample(df.limit(0)).count() == 0
