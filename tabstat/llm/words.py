"""Vectorised words and word n-gram hashes of Arrow text batches.

A word is a run of ASCII digits, ASCII letters (lower-cased) and non-ASCII
characters. On UTF-8 bytes that is one table lookup per byte, so whole
batches are cut and hashed by NumPy without a Python loop per word. Null
texts have no words. Hashes are 64 bits, equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # text handled at once; a longer text is a chunk of its own

_LUT = np.zeros(256, np.uint8)
_LUT[0x80:] = np.arange(0x80, 0x100)
_LUT[0x30:0x3A] = np.arange(0x30, 0x3A)
_LUT[0x61:0x7B] = np.arange(0x61, 0x7B)
_LUT[0x41:0x5B] = np.arange(0x61, 0x7B)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))


def constants(n: int, seed: int = 1) -> np.ndarray:
    """n odd 64-bit multipliers, fixed by the seed."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


@dataclass
class Words:
    """Words of texts ``first`` to ``first + n - 1`` of a batch."""

    first: int
    n: int
    hashes: np.ndarray  # uint64 per word
    doc: np.ndarray  # int64 per word: text number within the chunk
    bounds: np.ndarray  # n + 1: word range of each text
    starts: np.ndarray  # byte offset of each word within the chunk
    ends: np.ndarray
    data: np.ndarray  # the chunk's bytes
    offsets: np.ndarray  # n + 1 byte offsets of the texts within data

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _cut(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    n, size = len(offsets) - 1, len(data)
    low = _LUT[data]
    is_word = low != 0
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.zeros(size, bool)
    after = np.zeros(size, bool)
    if size:
        before[1:] = is_word[:-1]
        after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:size]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    lens = ends - starts
    if len(starts):
        at = np.flatnonzero(is_word)
        heads = np.concatenate(([0], np.cumsum(lens)[:-1]))
        within = np.arange(len(at)) - np.repeat(heads, lens)
        powers = constants(int(lens.max()), 7)
        hashes = mix(np.add.reduceat(_BYTE[low[at]] * powers[within], heads) + lens.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    return Words(first, n, hashes, doc, bounds, starts, ends, data, offsets)


def cut(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a string array, in chunks of about ``chunk_bytes``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    if texts.null_count:
        # a null has no bytes: rebuild without what may lie under it
        texts = pa.array(texts.fill_null(b""), pa.large_binary())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield _cut(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def grams(w: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of every run of k words inside one text."""
    c = constants(k, seed)
    m = len(w.hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h += w.hashes[j : m + j] * c[j]
    return mix(h[at]), at


def short_grams(w: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words of each text of 1 to k - 1 words."""
    n = w.counts()
    docs = np.flatnonzero((n > 0) & (n < k))
    c = constants(k, seed + 1)
    h = np.zeros(len(docs), np.uint64)
    for j in range(k - 1):
        has = n[docs] > j
        h[has] += w.hashes[w.bounds[docs[has]] + j] * c[j]
    return mix(h + n[docs].astype(np.uint64)), docs
