"""Vectorised word hashing over Arrow string batches.

A word is a maximal run of ASCII letters, digits and bytes >= 0x80 in the UTF-8 text, compared without regard to ASCII
case; everything else separates words. Work is done on whole batches with numpy, so its cost is a few passes over the
bytes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD1B54A32D192ED03 | 1

LUT = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LUT[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    LUT[_c] = _c | 0x20
LUT[0x80:] = np.arange(0x80, 0x100)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 12)
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BASE), Powers(WORD_BASE)


@dataclass
class Words:
    """The words of some documents, one after the other.

    hashes, start and end (byte offsets in the document) by word; first has the index of each document's first word and,
    at its end, the number of words.
    """

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array) -> Words:
    """Words of each text; a null or empty text has none."""
    data, at = text_buffer(texts)
    n = len(data)
    if not n:
        return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    low = LUT[data]
    inside = low != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[(at[1:] - 1)[at[1:] > 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _BYTES.get(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(low * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(U64))
    first = np.searchsorted(begins, at)
    base = np.repeat(at[:-1], np.diff(first))
    return Words(hashes, begins - base, ends - base, first)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a document, and the index of its first word."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    up, down = _WORDS.get(total)
    sums = np.empty(total + 1, U64)
    sums[0] = 0
    np.cumsum(words.hashes * up, out=sums[1:])
    left = np.maximum(np.diff(words.first) - n + 1, 0)
    ends = np.cumsum(left)
    at = np.arange(ends[-1]) + np.repeat(words.first[:-1] - (ends - left), left)
    return mix((sums[at + n] - sums[at]) * down[at] + U64(n)), at


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    span = 1
    out = values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def word_prefixes(data: np.ndarray, at: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Hash of the first n bytes of each word, or of the whole word if it is shorter."""
    if not len(words.hashes):
        return np.zeros(0, U64)
    up, down = _BYTES.get(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(LUT[data] * up, out=sums[1:])
    base = np.repeat(at[:-1], np.diff(words.first))
    a, b = base + words.start, base + words.end
    b = np.minimum(b, a + n)
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
