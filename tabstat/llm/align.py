"""Operator 12: cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes; a byte offset where tokens of both end is a
shared cut, and the tokens between neighbouring cuts form a group.

1. Per slice of an Arrow batch, each text is encoded by both tokenizers and
   its token ends become byte offsets. A document whose tokens' bytes differ
   from the text (or that is null or empty) has no tokens.
2. The slice's tokens are one interval. For every interval a common end near
   its middle is located by bisecting the other tokenizer's ends, trying the
   middle itself, then its neighbours outwards; both halves go on, and an
   interval without an inner cut is a leaf group. All intervals of a level go
   through the same array operations. Document ends are shared cuts, so no
   group spans two documents.
3. Each shared cut links the two tokens that end there. Links are kept packed
   with the document; their id pairs are counted over the corpus by
   ``groupBy`` on counts summed per task.
4. Documents look their links' counts up: pairs of the highest counts, at most
   ``SENT_PAIRS`` of them, in a broadcast table, the others by a shuffled join
   on the pair, so that no frequent pair gathers its rows in one task.

Cases: null and empty texts and those that a tokenizer doesn't give back byte
by byte have zeros and ''; rows are independent, so ties and repeated rows do
not matter (each counts); empty tables give empty results; ``align`` keeps
other columns whatever their names, but for its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .bpe import byte_table
from .shared import text_slices

SENT_PAIRS = 4_000_000  # pairs of the broadcast table, 16 bytes each
FLUSH_PAIRS = 500_000  # distinct pairs that a task gathers before it sends their counts
KEPT_CHUNKS = 100_000  # distinct chunks whose ids a worker remembers; beyond it, it starts over
SLICE_BYTES = 1 << 20  # of links that are looked up at once
_SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*")
_BEYOND_LATIN = re.compile("[\u0220-\U0010ffff]+")  # every young character is among these


@lru_cache(1)
def young_characters() -> re.Pattern:
    """Letters, digits and blanks that are newer than Unicode 3.2: two
    splitters may know them or not, as their Unicode tables are of different
    age; all others they class alike."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.ucd_3_2_0.category(c) == "Cn"]
    starts = [c for c, before in zip(codes, [None, *codes]) if before is None or c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], None]) if after is None or after != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


class Tokenizers:
    """The two tokenizers of one worker with the bytes of each token.

    Where a byte-level file's merges are in the order of their tokens' ids,
    its ids are ranks, and its texts are encoded by rank (same ids, a fifth of
    the time); texts with young characters, and files of any other kind, go
    through the file's own library. A worker keeps the ids of up to
    ``KEPT_CHUNKS`` chunks of the other tokenizer."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_table().items()}
        vocab = spec["model"]["vocab"]
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        both = (self.a_bytes, self.b_bytes)
        self.sizes = tuple(np.array([len(t) for t in side], np.int64) for side in both)
        self.bytes_of = tuple((np.frombuffer(b"".join(side), np.uint8), np.cumsum(n) - n) for side, n in zip(both, self.sizes))
        self.by_chunk = all(_SPACE not in p.lstrip(_SPACE) for p in pieces)
        self.kept: dict[str, bytes] = {}
        self.ranks = None
        if self._by_rank(spec):
            import tiktoken

            ranks = {self.a_bytes[i]: i for i in vocab.values()}
            special = {t["id"] for t in spec["added_tokens"]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for t, i in ranks.items() if i not in special}, special_tokens={})

    @staticmethod
    def _by_rank(spec: dict) -> bool:
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            return False
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return made == list(range(256, 256 + len(made)))

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.a_path)
        found.encode_special_tokens = True
        return found

    def encode_a(self, text: str) -> np.ndarray:
        if self.ranks is not None and (text.isascii() or not young_characters().search("".join(_BEYOND_LATIN.findall(text)))):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """No piece reaches over the start of a run of blanks (see
        ``by_chunk``), so a text's ids are those of its chunks, each a run of
        blanks and the word after it; chunks met before are looked up. The
        first blank of a chunk is the one that the model itself adds."""
        if not self.by_chunk:
            return [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]
        parts = []
        for t in texts:
            if t[-1:] == " " or _SPACE in t:  # blanks at the end; the model's own blank
                parts.append([t])
            elif t[:1] == " " or "  " in t:
                parts.append([c[1:] for c in _CHUNK.findall(" " + t)])
            else:
                parts.append(t.split(" "))
        kept = self.kept
        new = [c for c in set().union(*parts) if c not in kept]
        kept.update(zip(new, (array("I", ids).tobytes() for ids in self.b.encode(new, num_threads=1))))
        out = [np.frombuffer(b"".join([kept[c] for c in own]), "<u4").astype(np.int64) for own in parts]
        if len(kept) > KEPT_CHUNKS:
            kept.clear()
        else:
            for c in new:  # long ones are not kept
                if len(c) > 64:
                    del kept[c]
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both tokenizers; none if the bytes of either differ from
        space + text."""
        none = np.zeros(0, np.int64)
        real = [i for i, t in enumerate(texts) if t]
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        if not real:
            return out_a, out_b
        spaced = [" " + texts[i] for i in real]
        a, b = [self.encode_a(t) for t in spaced], self.encode_b([texts[i] for i in real])
        raw = [t.encode() for t in spaced]
        fits = self._gives(a, 0, raw) & self._gives(b, 1, raw)
        for k in np.flatnonzero(fits):
            out_a[real[k]], out_b[real[k]] = a[k], b[k]
        return out_a, out_b

    def _gives(self, ids: list[np.ndarray], side: int, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes are those of each text."""
        data, starts = self.bytes_of[side]
        every = np.concatenate(ids)
        size = self.sizes[side][every]
        ends = np.cumsum(size)
        made = data[np.repeat(starts[every] - (ends - size), size) + np.arange(size.sum())]
        n_made = np.bincount(np.repeat(np.arange(len(ids)), [len(x) for x in ids]), size, minlength=len(ids)).astype(np.int64)
        n_raw = np.array([len(r) for r in raw])
        if (n_made == n_raw).all():
            other = np.flatnonzero(made != np.frombuffer(b"".join(raw), np.uint8))
            return ~np.isin(np.arange(len(ids)), np.searchsorted(np.cumsum(n_raw), other, "right"))
        cuts = np.cumsum(n_made)
        return np.array([made[e - n : e].tobytes() == r for e, n, r in zip(cuts, n_made, raw)])


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both (strictly rising) lists of the ends they share, found by
    divide and conquer; the last ends must be equal."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = [np.array([len(a_ends) - 1])], [np.array([len(b_ends) - 1])]
    # an interval: the inner ends lo..hi - 1 of a and those of b between two cuts
    lo, hi = np.array([0]), np.array([len(a_ends) - 1])
    b_lo, b_hi = np.array([0]), np.array([len(b_ends) - 1])
    while len(lo):
        real = (lo < hi) & (b_lo < b_hi)
        lo, hi, b_lo, b_hi = lo[real], hi[real], b_lo[real], b_hi[real]
        middle = (lo + hi) // 2
        cut_a, cut_b = np.full(len(lo), -1), np.full(len(lo), -1)
        open_ = np.arange(len(lo))  # intervals that have no cut yet
        step = 0
        while len(open_):
            for at in (middle[open_] + step, middle[open_] - step) if step else (middle,):
                inside = np.flatnonzero((at >= lo[open_]) & (at < hi[open_]) & (cut_a[open_] < 0))
                which, place = open_[inside], at[inside]
                other = np.searchsorted(b_ends, a_ends[place])  # bisect
                hit = b_ends[other] == a_ends[place]
                cut_a[which[hit]], cut_b[which[hit]] = place[hit], other[hit]
            step += 1
            open_ = open_[(cut_a[open_] < 0) & ((middle[open_] + step < hi[open_]) | (middle[open_] - step >= lo[open_]))]
        cut = cut_a >= 0
        lo, hi, b_lo, b_hi, cut_a, cut_b = (x[cut] for x in (lo, hi, b_lo, b_hi, cut_a, cut_b))
        found_a.append(cut_a)
        found_b.append(cut_b)
        lo, hi = np.concatenate([lo, cut_a + 1]), np.concatenate([cut_a, hi])
        b_lo, b_hi = np.concatenate([b_lo, cut_b + 1]), np.concatenate([cut_b, b_hi])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _decimal(n: int, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters (a row each) and lengths of the numbers below n, each with
    either of two marks after it."""
    text = [str(i).encode() + bytes([e]) for i in range(n) for e in ends]
    width = max(map(len, text))
    chars = np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(len(text), width)
    return chars, np.array([len(t) for t in text])


class Aligner:
    """Groups and links of slices of texts."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.of = Tokenizers(a_path, b_path, pattern)
        a, b = _decimal(len(self.of.a_bytes), b",|"), _decimal(len(self.of.b_bytes), b",;")
        width = max(a[0].shape[1], b[0].shape[1])
        self.chars = np.concatenate([np.pad(x[0], ((0, 0), (0, width - x[0].shape[1]))) for x in (a, b)])
        self.length = np.concatenate([a[1], b[1]])
        self.b_from = len(a[0])

    def groups_text(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups as a1,a2|b1;a3|b2,b3; and the end of each group's text."""
        n_a, n_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(cut_a)), n_a), np.repeat(np.arange(len(cut_b)), n_b)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[cut_a], ends_b[cut_b] = 1, 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a * 2 + ends_a
        codes[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = self.b_from + b * 2 + ends_b
        length = self.length[codes]
        text = self.chars[codes][np.arange(self.chars.shape[1]) < length[:, None]]
        return text, np.cumsum(length)[np.cumsum(n_a + n_b) - 1]

    def rows(self, texts: list[str]) -> dict[str, list]:
        """n_a, n_b, n_groups, links (packed pairs) and groups digest of each text."""
        coded = self.of.encode(texts)
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in coded)
        a, b = (np.concatenate(side) for side in coded)
        if not len(a):
            zeros = [0] * len(texts)
            return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "links": [b""] * len(texts), "groups_sha256": [""] * len(texts)}
        a_size, b_size = self.of.sizes
        cut_a, cut_b = shared_cuts(np.cumsum(a_size[a]), np.cumsum(b_size[b]))
        pairs = (a[cut_a] << 32 | b[cut_b]).astype("<u8")
        text, ends = self.groups_text(a, b, cut_a, cut_b)
        last = np.searchsorted(cut_a, np.cumsum(n_a) - 1, "right")  # cuts up to the end of each text
        first = np.concatenate(([0], last[:-1]))
        raw = text.tobytes()
        digests = [hashlib.sha256(raw[ends[f - 1] if f else 0 : ends[e - 1] - 1]).hexdigest() if e > f else "" for f, e in zip(first.tolist(), last.tolist())]
        return {"n_a": n_a, "n_b": n_b, "n_groups": last - first, "links": [pairs[f:e].tobytes() for f, e in zip(first, last)], "groups_sha256": digests}


_ALIGNERS: dict = {}


def aligner(*files: str) -> Aligner:
    """One per worker; the files are part of the vocabulary package that every
    executor has."""
    if files not in _ALIGNERS:
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


def vocabularies() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


def align(docs: DataFrame, text_col: str = "text", files: tuple[str, str, str] | None = None) -> DataFrame:
    """docs without the text, plus n_a, n_b, n_groups, links (binary: 64-bit
    little-endian A id << 32 | B id of each shared cut, in order) and
    groups_sha256. ``files``: the byte-level file, the piece model and the
    pattern that the byte-level file's library splits by."""
    files = files or vocabularies()
    new = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "links": T.BinaryType(), "groups_sha256": T.StringType()}
    rest = [c for c in docs.columns if c not in new and c != text_col]
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("string").alias("__text"))
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "links": pa.binary(), "groups_sha256": pa.string()}

    def run(batches):
        by = aligner(*files)
        for batch in batches:
            for part in text_slices(batch, len(rest), 1 << 18):
                found = by.rows(part.column(len(rest)).to_pylist())
                arrays = [pa.array(found[c], kinds[c]) for c in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*rest, *kinds])

    return slim.mapInArrow(run, T.StructType([*[slim.schema[c] for c in rest], *[T.StructField(c, t) for c, t in new.items()]]))


def _pairs(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair) of all packed links."""
    raw = links.to_pylist()
    return np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]), np.frombuffer(b"".join(raw), "<u8").astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, b, n, best): links of each id pair over all rows, and whether
    no pair of the same B id has more."""

    def count(batches):
        parts, n = [], 0

        def send():
            unique, at = np.unique(np.concatenate([pairs for pairs, _ in parts]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([times for _, times in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(unique, pa.int64()), pa.array(sums, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for part in text_slices(batch, 0, SLICE_BYTES):
                unique, times = np.unique(_pairs(part.column(0))[1], return_counts=True)
                parts.append((unique, times))
                n += len(unique)
                if n >= FLUSH_PAIRS:
                    yield send()
                    parts, n = [], 0
        if n:
            yield send()

    counts = aligned.select("links").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select("pair", (F.col("pair").bitwiseAND(0xFFFFFFFF)).alias("b"), "n"), "pair_counts")
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return materialize(counts.join(top, "b").select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_counts(aligned: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The written table ``aligned`` (with a unique __row) with, in place of
    its links, n_links, n_best (links of a B id's most frequent pairs) and
    count_sum (sum of the links' counts)."""
    spark = aligned.sparkSession
    pairs = pair_counts(aligned)
    if pairs.count() <= sent_pairs:
        frequent, least = pairs, None
    else:
        # the count above which there are at most sent_pairs pairs
        by_count = pairs.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n"))
        least, left = None, sent_pairs
        for r in by_count.toLocalIterator():
            left -= r["pairs"]
            if left < 0:
                break
            least = r["n"]
        frequent = pairs.where(F.col("n") >= least) if least is not None else pairs.limit(0)
    table = frequent.orderBy("pair").toArrow()
    keys, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast((keys, n, best.astype(bool)))
    names = [c for c in aligned.columns if c != "links"]
    whole = least is None and len(keys) > 0

    def one(part):
        keys, n, best = sent.value
        row, pair = _pairs(part.column("links"))
        at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        size = part.num_rows
        sums = np.zeros(size, np.int64)
        np.add.at(sums, row[known], n[at[known]])
        bests = np.bincount(row[known], best[at[known]], minlength=size).astype(np.int64)
        links = np.bincount(row, minlength=size).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=size))))
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair[~known], pa.int64()))
        new = [*[pa.array(x, pa.int64()) for x in (links, bests, sums)], rest]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *new], names=[*names, "n_links", "n_best", "count_sum", "__rest"])

    def look_up(batches):
        for batch in batches:
            for part in text_slices(batch, batch.schema.get_field_index("links"), SLICE_BYTES):
                yield one(part)

    fields = [*[aligned.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")], T.StructField("__rest", T.ArrayType(T.LongType()))]
    out = aligned.mapInArrow(look_up, T.StructType(fields))
    if whole or not pairs.limit(1).count():
        return out.drop("__rest")
    out = materialize(out, "looked_up")
    rare = out.select("__row", F.explode("__rest").alias("pair")).join(pairs, "pair")
    sums = rare.groupBy("__row").agg(F.sum(F.col("best").cast("long")).alias("__best"), F.sum("n").alias("__sum"))
    out = out.drop("__rest").join(sums, "__row", "left")
    return out.select(*names, "n_links", *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_best", "__best"), ("count_sum", "__sum"))])


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    aligned = materialize(align(docs).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    return link_counts(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
