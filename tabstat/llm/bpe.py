"""Operator 2: byte-level BPE encoding and decoding.

A rank file (base64 token, rank per line) becomes a BPE model of the
``tokenizers`` library over the byte-to-character alphabet: token bytes are
written as printable characters, and every split of a token into two tokens
is a merge, ordered by the token's rank. Texts are split by the vocabulary's
pattern and every distinct match is encoded once per worker; a bounded table
keeps its ids. Ids are kept as little-endian unsigned 32-bit integers in a
binary column. Decoding reverses the byte table; as tokens may end inside a
character, bytes are joined before they are read as UTF-8.

Cases: null and empty texts have no ids and decode to empty bytes; bytes that
form no character decode to U+FFFD in ``decode_text`` only; an unknown id
raises; rows are independent, so ties and repeated rows do not matter; other
columns are kept by ``encode`` unless they are called like its own.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_PIECES = 200_000  # distinct matches a worker remembers; beyond it, it starts over


def byte_table() -> dict[int, str]:
    """The printable character of each byte: itself where it is printable,
    else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(shown))
    return table


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_lines.splitlines()) if t}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.table = byte_table()
        self.pattern_text = pattern
        self.kept: dict[str, bytes] = {}

    @cached_property
    def model(self):
        """The library's model; decoders do without it."""
        from tokenizers import models

        merges = []
        for token in sorted(self.ranks, key=self.ranks.get):
            halves = [(token[:i], token[i:]) for i in range(1, len(token))]
            halves = [(a, b) for a, b in halves if a in self.ranks and b in self.ranks]
            halves.sort(key=lambda p: (self.ranks[p[0]], self.ranks[p[1]]))
            merges += [(self.shown(a), self.shown(b)) for a, b in halves]
        return models.BPE(vocab={self.shown(t): r for t, r in self.ranks.items()}, merges=merges)

    @cached_property
    def pattern(self):
        import regex

        return regex.compile(self.pattern_text)

    def shown(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.table)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches. Characters that are newer than the Unicode
        tables of this Python are first classed as the rank files' own
        splitter classes them."""
        if not _new_characters().search(text):
            return self.pattern.findall(text)
        classes = _new_classes()
        shadow = "".join(classes.get(c, c) for c in text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]

    def piece_ids(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(self.shown(piece.encode()))]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        kept = self.kept
        pieces = self.pieces(text)
        for p in set(pieces):
            if p not in kept:
                kept[p] = self.piece_ids(p)
        out = b"".join([kept[p] for p in pieces])
        if len(kept) > KEPT_PIECES:
            kept.clear()
        return out

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """(start, end) code point offsets of each token, end exclusive; the
        parts of a split character all cover that character."""
        raw = text.encode()
        at = np.frombuffer(raw, np.uint8)
        char = np.cumsum((at & 0xC0) != 0x80) - 1  # character of each byte
        size = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(size)
        if not len(size):
            return np.zeros((0, 2), np.int64)
        return np.stack([char[ends - size], char[ends - 1] + 1], axis=1)

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of
        return b"".join([get[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(1)
def _new_list() -> list[str]:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return [c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]


@lru_cache(1)
def _new_characters():
    """Pattern of the characters that the two Unicode versions may class apart."""
    codes = sorted(map(ord, _new_list()))
    if not codes:
        return re.compile(r"(?!)")
    runs, start = [], codes[0]
    for a, b in zip(codes, [*codes[1:], None]):
        if b != a + 1:
            runs.append((start, a))
            start = b
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


@lru_cache(1)
def _new_classes() -> dict[str, str]:
    """A letter, digit or sign that stands for each such character, found by
    asking the splitter whether the character stays with one."""
    import tiktoken

    out: dict[str, str] = {}
    chars = _new_list()
    for lo in range(0, len(chars), 4000):
        part = chars[lo : lo + 4000]
        ranks = {bytes([i]): i for i in range(256)}
        for c in part:
            raw = c.encode()
            for kind in (b"a", b"1", b"!"):
                for j in range(1, len(raw) + 1):
                    ranks.setdefault(kind + raw[:j], len(ranks))
        enc = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
        for c in part:
            out[c] = next((k for k in "a1!" if len(enc.encode_ordinary(k + c)) == 1), " ")
    return out


_CODECS: dict = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and rank file; the file is part of the installed
    vocabulary package that every executor has."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, pattern] = Codec(f.read(), pattern)
    return _CODECS[path, pattern]


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _out_batches(arrays_of, batch: pa.RecordBatch, rows: int = 256):
    """Results in small batches: ids of long texts stay bounded in memory."""
    for i in range(0, batch.num_rows, rows):
        yield arrays_of(batch.slice(i, rows))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None,
           offsets: bool = False) -> DataFrame:
    """``docs`` without the text, plus ``ids`` (binary, little-endian uint32),
    ``n_tokens`` and, on demand, ``offsets`` (array of start, end)."""
    default = vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    own = {"ids", "n_tokens", "offsets", text_col}
    rest = [c for c in docs.columns if c not in own]
    slim = docs.select(*rest, F.col(text_col).cast("string").alias("__text"))
    fields = [slim.schema[c] for c in rest] + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.LongType())))

    def run(batches):
        c = codec(path, pattern)

        def one(part):
            texts = part.column(len(rest)).to_pylist()
            ids = [c.encode(t) if t else b"" for t in texts]
            arrays = [part.column(i) for i in range(len(rest))] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                arrays.append(pa.array([c.offsets(t or "", x).ravel().tolist() for t, x in zip(texts, ids)], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=[*rest, "ids", "n_tokens", *["offsets"] * offsets])

        for batch in batches:
            yield from _out_batches(one, batch)

    return slim.mapInArrow(run, T.StructType(fields))


def decode(coded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``coded`` plus ``decoded``, the bytes that the ids stand for."""
    default = vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    rest = [c for c in coded.columns if c != "decoded"]
    at = rest.index(ids_col)
    slim = coded.select(*rest)

    def run(batches):
        c = codec(path, pattern)

        def one(part):
            raw = pa.array([c.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*part.columns, raw], names=[*rest, "decoded"])

        for batch in batches:
            yield from _out_batches(one, batch)

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("decoded", T.BinaryType())]))


def decode_text(decoded: bytes) -> str:
    return decoded.decode("utf-8", "replace")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and digests of ids and decoded bytes."""
    both = decode(encode(docs.select("doc_id", "text")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
