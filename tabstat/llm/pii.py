r"""Operator 9: personal data by fixed patterns and a semi-Markov CRF.

Fixed patterns give the base spans (email, ip, card, phone; leftmost and not
overlapping per kind; matches that fail their check are dropped). Around
digits, at-signs and written-out forms of them, a semi-Markov conditional
random field then scores whole candidate segments of at most ``MAX_TOKENS``
tokens and ``MAX_CHARS`` characters by features of the span (digit and letter
counts, separators, shapes, check digits, the word before), and a dynamic
program over the tokens chooses boundaries and kinds together. Its segments
that overlap no base span are added; base spans always stay.

The field is trained here, by conditional likelihood, on neighbourhoods of
base spans in at most ``TRAIN_DOCS`` documents (those with the least hashes of
the documents that have a trigger, of ``TRAIN_CHARS`` characters at most; only
hashes are compared, no text moves before they are known), ``EXAMPLES`` of each
kind in a document, drawn by hash, with rewritten variants (a phone without its plus, an address with "at" and "dot")
and numbers that are no personal data as further examples. Without any base
span in the sample it adds nothing. A run of 512 tokens without a plain
stretch is scored in parts that share their last ``MAX_TOKENS`` tokens: each
segment is whole in one of them, but its neighbours across the cut do not
weigh in.

Cases: null and empty texts have no spans; offsets are code points, end
exclusive; rows are judged one by one, so ties and repeated rows do not
matter; empty tables give none; further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 8
MAX_CHARS = 64
NEAR_TOKENS = 3  # tokens kept on each side of a trigger
TRAIN_DOCS = 400
TRAIN_CHARS = 100_000
EXAMPLES = 4  # neighbourhoods of each kind that a sampled document gives
ROUNDS = 40

# fixed patterns; possessive where the next character cannot be in the run,
# and bound to the start of a digit run, which leaves the matches as they are
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            after = domain.end()
            out.append((start, after))
        at = text.find("@", max(at + 1, after))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


_TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]| dot ")
_TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"[^\W_]|[+(\[{]")
_SHAPES = [
    ("mail", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", re.A)),
    ("mail_words", re.compile(r"[\w.%+-]+ ?[\[({]? ?at ?[\])}]? ?[\w-]+(( ?[\[({]? ?dot ?[\])}]? ?|\.)[\w-]+)+", re.A)),
    ("four_parts", re.compile(r"\d{1,3}(\.\d{1,3}){3}")),
    ("ten_digits", re.compile(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}")),
    ("groups_of_four", re.compile(r"\d{4}([ .-]?\d{4}){3}")),
    ("phone_signs", re.compile(r"[+(]?[\d ().-]+\d")),
    ("card_signs", re.compile(r"\d[\d .-]+\d")),
    ("date", re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")),
    ("plain_number", re.compile(r"\d+")),
]
_CUES = {**dict.fromkeys(("phone", "tel", "call", "fax", "mobile", "cell"), "phone"), **dict.fromkeys(("email", "mail", "e-mail"), "email"),
         **dict.fromkeys(("ip", "host", "server"), "ip"), **dict.fromkeys(("card", "visa", "credit"), "card")}


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def span_features(text: str, start: int, end: int, n_tokens: int, before: str) -> list[str]:
    """Names of the features of a whole candidate span."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    out = ["one", f"digits{_bucket(len(digits), (1, 4, 7, 8, 10, 12, 14, 16, 20))}", f"letters{_bucket(sum(c.isalpha() for c in s), (1, 4, 9, 25))}",
           f"tokens{n_tokens}"]
    for name, shape in _SHAPES:
        if shape.fullmatch(s):
            out.append(name)
            if name == "four_parts" and not all(map(_octet, s.split("."))):
                out.append("large_part")
    if not any(x in out for x, _ in _SHAPES[:6]):
        out.append("no_shape")
    if len(digits) >= 13:
        out.append("luhn" if luhn(digits) else "no_luhn")
    out += [f"has{c}" for c in "@+(-.=" if c in s]
    if any(c in s for c in "=_\"'/:,;"):
        out.append("odd")
    if cue := _CUES.get(before.lower().strip(".:,;()")):
        out.append(f"cue_{cue}")
    return out


class Island:
    """A run of tokens around triggers, with its candidate segments."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n = len(tokens)
        self.places: list[tuple[int, int, int, int]] = []  # first token, after last, start, end
        self.features: list[list[str]] = []
        for i in range(self.n):
            before = text[slice(*tokens[i - 1])][-20:] if i else ""
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                a, b = tokens[i][0], tokens[j - 1][1]
                if b - a > MAX_CHARS + 8:
                    break
                while a < b and not _EDGE.match(text[a]):
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                # the last token must have a part in the span
                if b - a < 6 or b - a > MAX_CHARS or b <= tokens[j - 1][0] or a >= tokens[i][1] or not _TRIGGER.search(text[a:b]):
                    continue
                self.places.append((i, j, a, b))
                self.features.append(span_features(text, a, b, j - i, before))


def islands(text: str):
    """Islands of a text; one trigger's neighbourhood or several that touch."""
    if not _TRIGGER.search(text):
        return
    run: list[tuple[int, int]] = []
    past: list[tuple[int, int]] = []
    left = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        # a token with a trigger, or "dot", whose trigger has the blanks around it
        if _TRIGGER.search(text, max(0, a - 1), min(len(text), b + 1)):
            run = run or past[-NEAR_TOKENS:]
            run.append((a, b))
            left = NEAR_TOKENS
        elif run:
            run.append((a, b))
            left -= 1
            if not left:
                yield Island(text, run)
                past, run = run[-NEAR_TOKENS:], []
                continue
        past = (past + [(a, b)])[-NEAR_TOKENS:]
        if len(run) >= 512:  # a long run of numbers: cut it, keeping its end
            yield Island(text, run)
            run = run[-MAX_TOKENS:]
    if run:
        yield Island(text, run)


class Field:
    """Weights by feature name and kind."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights = weights

    def scores(self, island: Island) -> np.ndarray:
        zero = [0.0] * len(KINDS)
        get = self.weights.get
        return np.array([[sum(x) for x in zip(*[get(f, zero) for f in feats])] for feats in island.features]).reshape(-1, len(KINDS))

    def decode(self, island: Island) -> list[tuple[str, int, int]]:
        """The best segmentation; a token outside scores 0."""
        if not island.places:
            return []
        scores = self.scores(island)
        kind, score = scores.argmax(axis=1), scores.max(axis=1)
        by_end = defaultdict(list)
        for c, (i, j, _, _) in enumerate(island.places):
            if score[c] > 0:
                by_end[j].append((c, i))
        best, back = [0.0] * (island.n + 1), [None] * (island.n + 1)
        for j in range(1, island.n + 1):
            best[j] = best[j - 1]
            for c, i in by_end[j]:
                if best[i] + score[c] > best[j]:
                    best[j], back[j] = best[i] + score[c], c
        out, j = [], island.n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, _, a, b = island.places[back[j]]
                out.append((KINDS[kind[back[j]]], a, b))
                j = i
        return out[::-1]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, penalty: float = 0.05) -> Field:
    """Fit by conditional likelihood: for every island of the example texts the
    gold segmentation against the sum over all segmentations."""
    lots, names = [], {}
    for text, gold in examples:
        for island in islands(text):
            want = {(a, b): KINDS.index(k) for k, a, b in gold}
            marks = [want.get((a, b), -1) for _, _, a, b in island.places]
            inside = [g for g in gold if island.places and any(p[2] <= g[1] < p[3] for p in island.places)]
            if island.places and sum(m >= 0 for m in marks) >= len(inside):
                lots.append((island, marks))
    if not any(m >= 0 for _, marks in lots for m in marks):
        return Field({})
    flat, heads = [], []
    for island, _ in lots:
        for feats in island.features:
            heads.append(len(flat))
            flat += [names.setdefault(f, len(names)) for f in feats]
    flat, heads = np.array(flat), np.array(heads)
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(flat))))
    gold = np.zeros((len(heads), len(KINDS)))
    at = 0
    for island, marks in lots:
        for m in marks:
            if m >= 0:
                gold[at, m] = 1
            at += 1
    w, seen = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6)
    w[names["one"]] = -2.0  # most candidates are nothing
    if "no_shape" in names:
        w[names["no_shape"]] = -4.0
    for _ in range(rounds):
        scores = np.add.reduceat(w[flat], heads)
        total = np.logaddexp.reduce(scores, axis=1)
        prob = np.zeros(len(heads))
        at = 0
        for island, _ in lots:
            k = len(island.places)
            prob[at : at + k] = _marginals(island, total[at : at + k])
            at += k
        grad = np.zeros_like(w)
        np.add.at(grad, flat, (gold - prob[:, None] * np.exp(scores - total[:, None]))[owner])
        grad -= penalty * w
        seen += grad**2
        w += 0.5 * grad / np.sqrt(seen)
    return Field({name: w[i].tolist() for name, i in names.items()})


def _marginals(island: Island, total: np.ndarray) -> np.ndarray:
    """Probability of each candidate segment (any kind)."""
    n = island.n
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    by_end, by_start = defaultdict(list), defaultdict(list)
    for c, (i, j, _, _) in enumerate(island.places):
        by_end[j].append((c, i))
        by_start[i].append((c, j))
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *[ahead[i] + total[c] for c, i in by_end[j]]])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *[behind[j] + total[c] for c, j in by_start[i]]])
    return np.exp([ahead[i] + total[c] + behind[j] - ahead[n] for c, (i, j, _, _) in enumerate(island.places)])


# numbers that are no personal data, as further examples
_OTHERS = ["version 4.0.", "in 1998 and 2004", "on 2024-05-17 at 10.30", "about 1,250,000 people", "room 42", "page 1234567", "item 300.400.500.600 of",
           "number 1234567890123456 of", "serial 0000-1111-2222-3333 is", "ratio 3.14159265", "ISBN 978-3-16-148410-0 by", "id 20240517103000123 was", "100 200 300 400"]


def variants(kind: str, value: str) -> list[str]:
    """Other ways in which people write a value of a base span."""
    if kind == "email":
        name, _, host = value.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host}", f"{name}(at){host}"]
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]
    if kind == "card" and len(digits) == 16:
        return [".".join(digits[i : i + 4] for i in range(0, 16, 4))]
    return []


def examples_of(text: str, per_kind: int | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Neighbourhoods of the text's base spans, as they are and rewritten;
    ``per_kind``: of so many spans of each kind, drawn by a hash."""
    out = []
    spans = base_spans(text)
    chosen = spans
    if per_kind is not None:
        by_kind = defaultdict(list)
        for kind, a, b in spans:
            by_kind[kind].append((zlib.crc32(f"{text[a:b]}:{a}".encode()), kind, a, b))
        chosen = sorted(s[1:] for own in by_kind.values() for s in sorted(own)[:per_kind])
    for kind, a, b in chosen:
        lo, hi = max(0, a - 40), min(len(text), b + 40)
        lo = text.find(" ", lo, a) + 1 or a
        hi = text.rfind(" ", b, hi) if " " in text[b:hi] else b
        out.append((text[lo:hi], [(k, s - lo, e - lo) for k, s, e in spans if lo <= s and e <= hi]))
        for other in variants(kind, text[a:b]):
            out.append((f"{text[lo:a].rsplit('.', 1)[-1]}{other} and", [(kind, len(text[lo:a].rsplit('.', 1)[-1]), len(text[lo:a].rsplit('.', 1)[-1]) + len(other))]))
    return out


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = TRAIN_DOCS) -> DataFrame:
    """The texts of the n documents with a trigger that have the least hashes.
    Each task sends its n least hashes; texts are read again for those only,
    and texts of rows that repeat are one."""
    text = F.col(text_col).cast("string")
    some = docs.where(text.rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]") & (F.char_length(text) <= TRAIN_CHARS))
    some = some.select(text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    cut = some.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return some.where(F.col("h") <= F.lit(cut).cast("long")).dropDuplicates(["h"]).select("text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on the bounded sample of documents that hold a trigger."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())),
                           T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            found = [x for t in batch.column(0).to_pylist() for x in examples_of(t, EXAMPLES)]
            cols = [[t for t, _ in found], *[[[s[i] for s in g] for _, g in found] for i in range(3)]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())),
                                              *[pa.array(c, pa.list_(pa.int32())) for c in cols[2:]]], names=schema.names)

    rows = sample(docs, id_col, text_col).mapInArrow(run, schema).collect()
    examples = sorted({(r.text, tuple(zip(r.kinds, r.starts, r.ends))) for r in rows})
    if examples:
        examples += [(f"and so it was the {x} and so it went", ()) for x in _OTHERS for _ in range(5)]
    return train([(t, list(g)) for t, g in examples])


def find_spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by kind and start."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if field.weights:
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else None
        last = -1
        for island in islands(text):
            for kind, a, b in field.decode(island):
                before = int(np.searchsorted(starts, b)) - 1  # base spans that start before b
                if a >= last and (before < 0 or reach[before] <= a):
                    out.append((kind, a, b, False))
                    last = b
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: id, spans (kind, start, end, base)."""
    field = fit(docs, id_col, text_col) if field is None else field
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = T.StructType([slim.schema["id"], T.StructField("spans", spans)])

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(t, field)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_pii_semicrf(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format("filter(spans, x -> x.base)")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
