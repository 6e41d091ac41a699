"""Cross-tokenizer alignment against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.llm import align
from tabstat.session import materialize


def brute(texts):
    """Groups and links by walking both token lists byte by byte."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = {c: b for b, c in align.byte_table().items()}
    docs = []
    for t in texts:
        if not t:
            docs.append(([], [], [], []))
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        ab = [bytes(table[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = []
        for i in b:
            p = b_tok.id_to_piece(i)
            bb.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode())
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            docs.append(([], [], [], []))
            continue
        groups, links, i, j, x, y, g, h = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x, i = x + len(ab[i]), i + 1
                g.append(a[i - 1])
            else:
                y, j = y + len(bb[j]), j + 1
                h.append(b[j - 1])
            if x == y:
                groups.append(",".join(map(str, g)) + "|" + ",".join(map(str, h)))
                links.append((g[-1], h[-1]))
                g, h = [], []
        docs.append((a, b, groups, links))
    count = Counter(p for d in docs for p in d[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, k in docs]


def run(df, **options):
    aligned = materialize(align.align(df).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    return align.link_counts(aligned, **options)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "the quick brown fox", "the quick brown fox", None, "", " ", "  two  spaces\n\nlines\t tab", "ça va 日本語 🙂🙂 ▁ odd", "ça va 日本語 🙂🙂 straße",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a" * 5000, "9" * 300 + "@" * 50, "ﬁ ligature   nbsp", "\x00nul\x7f", "Unbelievable tokenizations, isn't it?",
]


@pytest.mark.parametrize("sent_pairs", [align.SENT_PAIRS, 40, 0])
def test_equal_to_brute_force(spark, sent_pairs):
    r = random.Random(2)
    words = ["the", "Quick", "naïve", "日本語", "🙂", "x=1;", "tokenization", "of", "  ", "\n"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in run(df, sent_pairs=sent_pairs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_ids_by_rank_equal_the_library():
    of = align.Tokenizers(*align.vocabularies())
    assert of.ranks is not None
    young = chr(0x16F00) + chr(0x1E900) + chr(0x30000) + chr(0xA7CB)
    assert align.young_characters().search(young) and not align.young_characters().search("aé日本語🙂١½\u00a0")
    r = random.Random(1)
    chars = "abc ABC'sll  \n\t123½é日本語🙂١\u00a0\u2003-—" + young
    for _ in range(300):
        text = " " + "".join(r.choice(chars) for _ in range(r.randrange(1, 80)))
        assert of.encode_a(text).tolist() == of.a.encode(text, add_special_tokens=False).ids


def test_ids_by_chunk_equal_the_library(monkeypatch):
    of = align.Tokenizers(*align.vocabularies())
    assert of.by_chunk
    monkeypatch.setattr(align, "KEPT_CHUNKS", 50)
    r = random.Random(3)
    chars = "aab cc   \n\t▁é日🙂ﬁ\u3000\u00a0<s></s>" + "x" * 3
    for _ in range(40):
        texts = ["".join(r.choice(chars) for _ in range(r.randrange(1, 60))) for _ in range(10)] + [" ", "   ", "a", " a ", "y" * 200]
        assert [x.tolist() for x in of.encode_b(texts)] == of.b.encode(texts)


def test_cuts_equal_the_intersection():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 500, 5000):
        for share in (0.02, 0.5, 0.98):
            ends = np.arange(1, n + 1)
            a, b = (np.append(ends[:-1][rng.random(n - 1) < share], n) for _ in range(2))
            at_a, at_b = align.shared_cuts(a, b)
            assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()
    assert len(align.shared_cuts(np.zeros(0, int), np.zeros(0, int))[0]) == 0


def test_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((x.doc_id, *y) for x, y in zip(rows, brute([x.text for x in rows]))), key=repr)
    out = run(odd_docs)
    assert sorted(((x.doc_id, *(x[c] for c in COLUMNS)) for x in out.collect()), key=repr) == want
    assert {"h", "pos", "bucket", "lang"} <= set(out.columns)
    assert run(odd_docs.limit(0)).count() == 0
