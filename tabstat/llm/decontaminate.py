"""Operator 1: benchmark decontamination by one Aho-Corasick automaton.

Benchmark items are normalised to words (ASCII lower-cased; runs of digits,
letters and non-ASCII characters) and cut into windows of ``window`` words;
an item with fewer, but not none, is one window. Every benchmark word gets
one letter of a private alphabet, so a window is a short string and a
document becomes a string with one letter per word (unknown words share a
letter that no window has). One automaton over the windows then scans each
document once and its positions are word numbers; they are mapped to
character offsets of the original text.

Cases: a null or empty text has no words, no hits and is not contaminated; a
null item text gives no window; a null item id is written as an empty string;
an item that occurs twice counts once per distinct id; repeated documents are
reported once per row; other columns of the documents do not matter for the
report and pass through the filter unchanged.

The benchmark is a stated query set: it goes to the workers in blocks of at
most ``BLOCK_BYTES`` of item text and ``BLOCK_WORDS`` distinct words (a longer
item is cut into parts that share ``window`` - 1 words, so that no window is
lost), one automaton per block.
Ordinary benchmarks are one block, and one scan gives the report. With more
blocks the documents are scanned once per block with that block's automaton;
only texts with a hit leave a scan, and their hits are merged by the text's
hash in a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .shared import BROADCAST_BYTES

WINDOW = 13
SHARE = (1, 20)  # hit words over words from which a document is contaminated
BLOCK_BYTES = 2 << 20
BLOCK_WORDS = 60_000  # distinct words of a block; building the automaton takes their square at worst

_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
               for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original, with capitals
_LETTERS = 0x1000  # first letter of the private alphabet
_UNKNOWN = "\x01"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Matcher:
    """The automaton over one block of (item_id, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.letter: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            found = words((text or "").encode())
            for i in range(max(1, len(found) - window + 1) if found else 0):
                key = "".join(self._letter(w) for w in found[i : i + window])
                owners.setdefault(key, set()).add("" if item is None else item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _letter(self, word: bytes) -> str:
        if word not in self.letter:
            code = _LETTERS + len(self.letter)
            # surrogates are no letters
            self.letter[word] = chr(code if code < 0xD800 else code + 0x800)
        return self.letter[word]

    def scan(self, found: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """Items with an occurring window, and the merged word ranges hit."""
        get = self.letter.get
        line = "".join([get(w, _UNKNOWN) for w in found])
        ids: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for end, (size, owners) in self.automaton.iter(line):
            ids.update(owners)
            ranges.append((end - size + 1, end + 1))
        return ids, merge(ranges)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict = {}


def _matcher(block, window: int) -> Matcher:
    """Built once per worker and block; a block carries its own name, as a
    worker lives longer than its broadcasts."""
    name, items = block.value
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = Matcher(items, window)
    return _BUILT[name, window]


def _parts(text: str, window: int) -> Iterator[tuple[str, set[bytes]]]:
    """The text in parts of at most a block that share ``window`` - 1 words,
    each with its distinct words."""
    raw = text.encode()
    found = words(raw)
    if len(raw) <= BLOCK_BYTES and len(found) <= BLOCK_WORDS:
        yield text, set(found)
        return
    fit = min(BLOCK_WORDS, BLOCK_BYTES // (max(map(len, found), default=1) + 1))
    step = max(1, fit - window + 1)
    for i in range(0, max(1, len(found) - window + 1), step):
        part = found[i : i + step + window - 1]
        yield b" ".join(part).decode(), set(part)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of bounded size, streamed by partition."""
    block: list[tuple] = []
    size, known = 0, set()
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in items.toLocalIterator():
        for part, own in _parts(text or "", window):
            n = len(part.encode())
            if block and (size + n > BLOCK_BYTES or len(known) + len(own - known) > BLOCK_WORDS):
                yield block
                block, size, known = [], 0, set()
            block.append((item, part))
            size += n
            known |= own
    if block:
        yield block


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType()),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("contaminated", pa.bool_()),
])


def _scan(raw: bytes | None, matcher: Matcher) -> tuple[list[bytes], set[str], list[tuple[int, int]]]:
    found = words(raw or b"")
    ids, ranges = matcher.scan(found) if found and not matcher.empty else (set(), [])
    return found, ids, ranges


def _row(raw: bytes | None, found: list[bytes], ids: set[str], ranges: list[tuple[int, int]], share: tuple[int, int]) -> dict:
    n_hit = sum(b - a for a, b in ranges)
    spans = []
    if ranges:
        at = [x.span() for x in _WORD.finditer(raw.decode())]
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
    return {"n_words": len(found), "n_hit": n_hit, "items": sorted(ids), "spans": spans,
            "contaminated": n_hit > 0 and n_hit * share[1] >= len(found) * share[0]}


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, share: tuple[int, int]) -> DataFrame:
    """docs plus __found, the report of each text."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast((uuid.uuid4().hex, b)) for b in [*_blocks(benchmark, item_col, item_text_col, window)] or [[]]]
    text = F.col(f"`{text_col}`").cast("string")
    schema = T.StructType([*docs.schema.fields, T.StructField("__found", _FOUND)])
    names, place = docs.columns, docs.columns.index(text_col)

    def with_found(batch, rows):
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(rows, _ARROW)], names=[*names, "__found"])

    if len(blocks) == 1:
        def run(batches):
            for batch in batches:
                raws = batch.column(place).cast(pa.string()).cast(pa.binary()).to_pylist()
                matcher = _matcher(blocks[0], window)
                yield with_found(batch, [_row(raw, *_scan(raw, matcher), share) for raw in raws])

        return docs.mapInArrow(run, schema)

    # equal texts have equal hits, so a text is named by its hash
    keys = [F.xxhash64(text).alias("__t1"), F.hash(text).alias("__t2")]
    slim = docs.select(*keys, text.alias("text"))
    hits = None
    for block in blocks:
        def hit(batches, block=block):
            for batch in batches:
                matcher = _matcher(block, window)
                out = [(a, b, sorted(ids), [x for r in ranges for x in r])
                       for a, b, raw in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))])
                       for _, ids, ranges in [_scan(raw, matcher)] if ranges]
                cols = list(zip(*out)) or [()] * 4
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["__t1", "__t2", "ids", "ranges"])

        part = slim.mapInArrow(hit, "__t1 bigint, __t2 int, ids array<string>, ranges array<bigint>")
        hits = part if hits is None else hits.unionByName(part)
    # a row per text and block at most, however often the text is repeated
    merged = hits.groupBy("__t1", "__t2").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("__ids"), F.flatten(F.collect_set("ranges")).alias("__ranges"))
    merged = materialize(merged, "benchmark_hits")
    size = merged.agg(F.sum(F.size("__ranges") * 8 + F.length(F.array_join("__ids", ",")) + 64)).first()[0] or 0
    merged = F.broadcast(merged) if size <= BROADCAST_BYTES else merged
    joined = docs.select("*", *keys).join(merged, ["__t1", "__t2"], "left").select(*[F.col(f"`{c}`") for c in names], "__ids", "__ranges")

    def finish(batches):
        for batch in batches:
            raws = batch.column(place).cast(pa.string()).cast(pa.binary()).to_pylist()
            rows = []
            for raw, ids, flat in zip(raws, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                rows.append(_row(raw, words(raw or b""), set(ids or ()), merge(list(zip(flat[::2], flat[1::2]))) if flat else [], share))
            yield with_found(batch, rows)

    return joined.mapInArrow(finish, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per document: id, n_words, n_hit, items, spans, contaminated."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    out = _found(slim, benchmark, "__text", item_col, item_text_col, window, share)
    return out.select(F.col("__id").alias(id_col), "__found.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    out = _found(docs, benchmark, text_col, item_col, item_text_col, window, share)
    return out.where("NOT __found.contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_NORM = "regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".replace(
    "lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NORM} AS w FROM documents),
b AS (SELECT item_id, {_NORM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i+12]) AS n, array_to_string(w[i:i+12], ' ') AS k
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS k
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw ON hw.r = d.r LEFT JOIN hi ON hi.r = d.r
"""
