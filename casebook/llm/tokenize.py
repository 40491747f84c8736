"""Byte-level BPE ids of whole texts, through ``tokenizers``, for Arrow batches.

A text may be cut wherever the pre-tokenizer cuts it anyway: before a single space
that is followed by a non-blank (it goes with what follows), after a line break that
stands alone between ASCII non-blanks, and between an ASCII letter and ASCII punctuation
other than the apostrophe.  The pieces then have the ids of the whole.  The distinct
pieces of a batch are encoded once and looked up.  The tokenizer's added tokens are
found first: each is a piece of its own, and text ends and begins anew around it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casebook.llm.words import hash_bytes, text_bytes

#: A following byte that is blank, or may begin a blank beyond ASCII: no cut there.
NO_CUT = np.zeros(256, bool)
NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True

#: Bytes of pieces and ids that a worker keeps; beyond that it begins anew.
CACHE_BYTES = 24 << 20
ENCODED_AT_ONCE = 5_000


class Encoder:
    """Keeps the ids of pieces seen before as flat arrays, sorted by the piece's
    64-bit hash; hash and byte length together name a piece."""

    _of_worker: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this Python worker, which lives on between tasks."""
        if path not in cls._of_worker:
            cls._of_worker[path] = cls(path)
        return cls._of_worker[path]

    def __init__(self, path: str):
        self.path = path
        self._tokenizer = None
        self._added = None
        self._forget()

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    @property
    def added(self) -> re.Pattern:
        """Matches the added tokens' bytes, the longest at a place."""
        if self._added is None:
            tokens = list(self.tokenizer.get_added_tokens_decoder().values())
            if self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in tokens):
                raise ValueError("texts cannot be cut around added tokens that depend on their neighbours")
            names = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
            self._added = re.compile(b"|".join(map(re.escape, names)) or rb"(?!)")
        return self._added

    def _cut_out_added(self, raw: np.ndarray, off: np.ndarray, cut: np.ndarray) -> None:
        found = [m.span() for m in self.added.finditer(raw)]
        if not found:
            return
        # A match may run across two texts: search again in each text it touches.
        touched = np.unique(np.searchsorted(off, np.array(found) - [0, 1], side="right") - 1)
        found = [m.span() for t in touched for m in self.added.finditer(raw, int(off[t]), int(off[t + 1]))]
        for first, _ in found:
            cut[max(first - 1, 0)] = False  # like a text's last byte
        for first, end in found:
            cut[first:end] = False
        for first, end in found:
            cut[[first, end]] = True

    def rest(self) -> None:
        """Between tasks only the flat arrays stay in the worker's memory."""
        self._tokenizer = None

    def _forget(self) -> None:
        self._unusual = False
        self.keys = np.zeros(0, np.uint64)
        self.bytes = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        inside = np.minimum(at, max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return inside, np.zeros(len(keys), bool)
        return inside, (self.keys[inside] == keys) & (self.bytes[inside] == lengths)

    def _learn(self, values: list[bytes], keys: np.ndarray, lengths: np.ndarray) -> None:
        ids, size = array("I"), array("i")
        for i in range(0, len(values), ENCODED_AT_ONCE):
            part = [v.decode("utf-8") for v in values[i:i + ENCODED_AT_ONCE]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                before = len(ids)
                ids.extend(e.ids)
                size.append(len(ids) - before)
        size = np.array(size, np.int32)
        first = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys, keys[order])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        self.bytes = np.insert(self.bytes, at, lengths[order])
        self.first = np.insert(self.first, at, first[order])
        self.size = np.insert(self.size, at, size[order])
        self.keys = np.insert(self.keys, at, keys[order])

    def pieces(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``self.ids``, number of ids) of each distinct piece."""
        if self._unusual or 24 * (len(self.keys) + len(values)) + 4 * len(self.ids) > CACHE_BYTES:
            self._forget()
        keys = hash_bytes(values)
        lengths = pc.binary_length(values).to_numpy().astype(np.int32)
        _, known = self._find(keys, lengths)
        new = np.flatnonzero(~known)
        if new.size:
            self._learn(values.take(pa.array(new)).to_pylist(), keys[new], lengths[new])
        at, known = self._find(keys, lengths)
        named = np.lexsort((lengths, keys))
        twice = (np.diff(keys[named].astype(np.int64)) == 0) & (np.diff(lengths[named]) == 0)
        if not known.all() or twice.any():
            # Two pieces share a hash: these go by their numbers, and nothing of them is kept.
            self._forget()
            self._learn(values.to_pylist(), np.arange(len(values), dtype=np.uint64), lengths)
            self._unusual = True
            return self.first, self.size.astype(np.int64)
        return self.first[at], self.size[at].astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of each text)."""
        raw, off = text_bytes(texts)
        if raw.size == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cut = np.zeros(raw.size + 1, bool)
        cut[:-2] = (raw[:-1] == 0x20) & ~NO_CUT[raw[1:]]
        cut[np.maximum(off[1:] - 1, 0)] = False  # a text's last byte
        letter, mark = LETTER[raw], PUNCTUATION[raw]
        cut[1:-1] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        visible = VISIBLE[raw]
        cut[2:-1] |= visible[:-2] & (raw[1:-1] == 0x0A) & visible[2:]
        self._cut_out_added(raw, off, cut)
        cut[off] = True
        cuts = np.flatnonzero(cut)
        runs = pa.Array.from_buffers(pa.large_binary(), cuts.size - 1,
                                     [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = runs.dictionary_encode()
        code = coded.indices.to_numpy()
        first, size = self.pieces(coded.dictionary)
        length = size[code]
        end = np.cumsum(length)
        at = np.arange(end[-1]) + np.repeat(first[code] - (end - length), length)
        total = np.concatenate([[0], end])
        return self.ids[at], total[np.searchsorted(cuts, off)]
