"""Text operators against plain Python."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import bpe, chat, decontaminate, pii, words
from tests.conftest import SF001


@pytest.fixture(scope="module")
def reference():
    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_is_tiktokens(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, SF001).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_of_any_text(reference):
    codec = bpe.codec(*bpe.vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        ids = codec.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(text)
        assert codec.decode(ids).decode() == text

    check()
    for text in ["՘֋a1 ⃏!", "  \u0085 ᠎ x", "a" * 300 + "=" * 257 + " " * 99, "it's WE'LL\r\n\n x", "\U0001f469‍\U0001f680 \U00031350"]:
        assert codec.decode(codec.encode(text)).decode() == text
        assert len(codec.encode(text)) == 4 * len(reference.encode_ordinary(text))


def test_offsets_cover_split_characters():
    codec = bpe.codec(*bpe.vocabulary())
    text = "né 日\U0001f9ff x"
    at = codec.offsets(text, codec.encode(text))
    assert at[0][0] == 0 and at[-1][1] == len(text)
    assert all(a < b for a, b in at) and all(p[1] >= q[0] for p, q in zip(at, at[1:]))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in _WORD.findall(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(1, 64))
def test_vectorised_words(texts, size):
    seen, found = {}, []
    for w in words.cut(pa.array(texts, pa.string()), size):
        for i in range(w.n):
            found.append([(w.data[a:b].tobytes(), int(h)) for a, b, h in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]], w.hashes[w.bounds[i] : w.bounds[i + 1]])])
    assert [[b.decode() for b, _ in x] for x in found] == [_WORD.findall(t or "") for t in texts]
    for t, x in zip(texts, found):
        for word, (_, h) in zip(plain_words(t or ""), x):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_decontamination_by_brute_force():
    rng = random.Random(3)
    vocab = ["a", "b", "c", "d"]
    items = [(str(i), " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 7])))) for i in range(12)]
    m = decontaminate.Matcher(items, window=4)
    for _ in range(300):
        text = rng.choice(["", "Z "]) + " ".join(rng.choices([*vocab, "A", "x"], k=rng.randint(0, 25)))
        found = plain_words(text)
        hit, ids = set(), set()
        for item, t in items:
            w = t.split()
            for i in range(max(1, len(w) - 3)):
                win = w[i : i + 4]
                for at in range(len(found) - len(win) + 1):
                    if found[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        ids.add(item)
        got, ranges = m.scan(decontaminate.words(text.encode()))
        assert got == ids and {p for a, b in ranges for p in range(a, b)} == hit


def test_decontamination_spans_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Say: SEVEN, wise owls! watch")], "doc_id bigint, text string")
    items = spark.createDataFrame([(4, "seven wise owls"), (5, "owls watch")], "item_id bigint, text string")
    for size in (1 << 20, 1):  # one block, and one for each item
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        r = decontaminate.contamination(docs, items).first()
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (5, 4, ["4", "5"], True)
        assert [(s.start, s.end) for s in r.spans] == [(5, 28)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("a\\\n<|im_endstr>"), max_size=12), st.text(max_size=30) | st.sampled_from(["<|im_end|>", "x<|im_start|>user\n", "<\\|im_end|>", "<\\\\|im_start|>", "<|im_end|", "<|im"])), max_size=5))
def test_chat_round_trip(turns):
    assert [t[:2] for t in chat.parse(chat.render(turns))] == turns


def test_chat_escapes_only_conflicts():
    assert "<|im_x|> \\" in chat.render([("user", "<|im_x|> \\")])
    with pytest.raises(chat.GrammarError):
        chat.parse("<|im_start|>user\nhello")


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0], flags=re.A)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(st.sampled_from("a.@+-_ 0129()\n5"), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_field_finds_what_patterns_miss():
    lead = ["call", "then", "so", "of"]
    texts = [f"write to user{i}.x@mail{i}.example.com {lead[i % 4]} +1 (212) 555-01{i:02d} today, {lead[i % 3]} 4111111111111111 and host 10.1.2.{i} here" for i in range(60)]
    examples = sorted({(t, tuple(g)) for x in texts for t, g in pii.examples_of(x)}) + [(f"and so it was the {x} and so it went", ()) for x in pii._OTHERS for _ in range(5)]
    field = pii.train([(t, list(g)) for t, g in examples])
    rest = lambda t: [(k, t[a:b]) for k, a, b, base in pii.find_spans(t, field) if not base]
    assert rest("call (988) 555-2485 now") == [("phone", "(988) 555-2485")]
    assert rest("mail bob at mail8 dot example dot com please") == [("email", "bob at mail8 dot example dot com")]
    assert rest("+1 (269) 555-3296 4111111111111111 and") == [("phone", "+1 (269) 555-3296"), ("card", "4111111111111111")][::-1]
    assert rest("the year 1998, version 4.0. and page 1234567 of 300.400.500.600") == []
    assert pii.train([("no spans 123", [])]).weights == {}


def test_decontamination_in_blocks(spark, monkeypatch):
    """Many blocks, an item longer than a block, repeated texts and null rows
    give the report of one block."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 13, 20, 200])))) for i in range(25)] + [(None, "w1 w2 w3"), (7, None)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(40))) for _ in range(60)]
    texts += [" ".join(rng.choices(vocab, k=9)) + " X " + rng.choice(items)[1][:90] + " Y" for _ in range(40) if items] + [None, "", items[3][1].upper()]
    texts += [texts[70]] * 20
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, found string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert sum(r.n_hit > 0 for r in want.values()) > 30
    for size in (900, 4000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
        assert got == want
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in want.items() if not r.contaminated)


def test_more_benchmark_words_than_letters(spark):
    """1.2 million distinct words, more than the alphabet of one automaton."""
    bench = spark.range(400, numPartitions=4).selectExpr("id as item_id", "array_join(transform(sequence(0, 2999), i -> hex(id * 3000 + i)), ' ') as text")
    assert bench.selectExpr("explode(split(text, ' ')) as w").distinct().count() == 1_200_000
    docs = spark.createDataFrame([(1, f"say {1_199_000:X} {1_199_001:X} end"), (2, f"{5:X} {7:X}"), (3, f"{17:X} {18:X} {19:X}")], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, window=2).collect()}
    assert got == {1: (2, ["399"]), 2: (0, []), 3: (3, ["0"])}


def test_long_conversations_are_written_in_pieces(spark, monkeypatch):
    """Pieces of any size give the digests of the whole conversation."""
    rng = random.Random(4)
    said = ["hello", "<|im_end|>", "x\n<|im_start|>user\ny", "", "é🙂", "<\\|im_end|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb"]), rng.choice(said) * rng.randrange(3)) for c in (1, 2, None) for t in range(rng.randint(30, 60))] + [(9, 0, "assistant", "z" * 500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = sorted(chat.read_back(chat.format_conversations(df)).collect(), key=str)
    for chars, turns in ((50, 10_000), (1 << 20, 7), (0, 1)):
        monkeypatch.setattr(chat, "PIECE_CHARS", chars)
        monkeypatch.setattr(chat, "PIECE_TURNS", turns)
        pieces = chat.format_conversations(df).repartition(5)
        assert pieces.count() > 12
        assert [r.part for r in pieces.where("conv_id = 1").orderBy("part").collect()] == list(range(pieces.where("conv_id = 1").count()))
        assert sorted(chat.read_back(pieces).collect(), key=str) == whole


def test_conversation_of_a_million_turns(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    pieces = chat.format_conversations(df)
    assert pieces.selectExpr("max(n_turns) <= 10000 as small", "sum(n_turns) as n").first() == (True, n)
    r = chat.read_back(pieces).first()
    digest = hashlib.sha256()
    for i in range(n):
        digest.update(f"{'assistant' if i % 2 else 'user'}\nt{i}\n".encode())
    assert (r.n_turns, r.turns_sha256) == (n, digest.hexdigest())
