"""Vectorised word splitting over Arrow batches (used inside Spark tasks).

A word is a maximal run of characters other than space and U+0009..U+000D; all
of those are single bytes in UTF-8, so splitting works on the raw bytes of a
whole Arrow column at once, with no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BATCH_BYTES = 2 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece hold about ``max_bytes``
    (one longer text makes a piece of its own).  Frees memory after the last."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, int64 offsets of each text); null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a batch of texts: ``codes`` into ``vocab``, text by text."""
    counts: np.ndarray   # words per text
    codes: np.ndarray    # int64 code of each word, texts one after the other
    vocab: pa.Array      # binary; also holds the gaps between words (unused codes)
    starts: np.ndarray   # byte position of each word in the batch
    ends: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Word index at which each text begins (and the total at the end)."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every vocabulary entry."""
        return hash_bytes(self.vocab)


#: A fixed random 64-bit weight for every byte value; base and its inverse mod 2^64.
WEIGHT = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64; grown as needed and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def hash_bytes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each binary value, for the whole array at once: the weighted
    bytes as a polynomial mod 2^64, taken from prefix sums, then finalised."""
    if len(values) == 0:
        return np.zeros(0, np.uint64)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, kind)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(WEIGHT[raw] * powers(BASE, raw.size), out=sums[1:])
    size = (off[1:] - off[:-1]).astype(np.uint64)
    return mix((sums[off[1:]] - sums[off[:-1]]) * powers(INVERSE, raw.size + 1)[off[:-1]] + mix(size + np.uint64(1)))


def last_bytes(values: pa.Array) -> np.ndarray:
    """The last two bytes of each non-empty value as a number below 65,536."""
    if len(values) == 0:
        return np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, kind)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    size = off[1:] - off[:-1]
    last = np.where(size > 0, raw[np.maximum(off[1:] - 1, 0)], 0)
    return last + 256 * np.where(size > 1, raw[np.maximum(off[1:] - 2, 0)], 0)


def split_words(texts: pa.Array, lower: bool = False, keep: np.ndarray = IS_WORD) -> Words:
    """The runs of bytes that ``keep`` marks, by default words."""
    raw, off = text_bytes(texts)
    n = len(off) - 1
    if lower:
        raw = LOWER[raw]
    if raw.size == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(n, np.int64), none, pa.array([], pa.binary()), none, none, raw, off)
    word = keep[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = off[:-1] < off[1:]
    first[off[:-1][filled]] |= word[off[:-1][filled]]
    last[off[1:][filled] - 1] |= word[off[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, off))
    if starts.size == 0:
        none = np.zeros(0, np.int64)
        return Words(counts, none, pa.array([], pa.binary()), starts, ends, raw, off)
    cuts = np.empty(2 * starts.size, np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    kind, of = (pa.large_binary(), cuts) if raw.size >= 1 << 31 else (pa.binary(), cuts.astype(np.int32))
    runs = pa.Array.from_buffers(kind, cuts.size - 1,
                                 [None, pa.py_buffer(of), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = runs.dictionary_encode()
    codes = coded.indices.to_numpy()[0::2].astype(np.int64)
    return Words(counts, codes, coded.dictionary, starts, ends, raw, off)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit reaches every output bit)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(word_hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word window inside one text and the text it is in.

    ``word_hashes``: per word, texts one after the other.  Texts with fewer
    words have no window here.
    """
    n = word_hashes.size
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:n - size + 1 + i] + np.uint64(i + 1))
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:n - size + 1] == text[size - 1:]
    return acc[inside], text[:n - size + 1][inside]
