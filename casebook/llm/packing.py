"""Harmonic packing of token sequences (operator 2).

Lengths fall into reciprocal-capacity classes: class j holds the lengths in
(C/(j+1), C/j], and each of its bins takes exactly j pieces.  Every task fills
the bins of its own classes; nothing is shuffled and no task waits for another.

A document is first cut into whole sequences of C tokens.  A remainder that would
leave more than ``slack`` of its class's bins empty is cut at the next reciprocal,
C // (j+1), which fills bins of class j+1.  Lengths under C / ``classes`` form the
last class, whose pieces are laid end to end and cut at C.  What a task has left in
open bins at its end goes the same way, and the last open sequence is cut at its
binary digits, since a sequence whose length is a power of two needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.tokenize import Encoder
from casebook.llm.words import give_back, slices
from casebook.session import ship_package

Piece = tuple[int, int, np.ndarray]  # document number in the task, start, ids

END = 1


def cut_lengths(n: int, capacity: int, classes: int, slack: float) -> list[int]:
    """Lengths into which a document of ``n`` tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if j >= classes or capacity - j * rest <= slack * capacity:
            out.append(rest)
            break
        head = capacity // (j + 1)
        out.append(head)
        rest -= head
    return out


class Packer:
    """Fills the bins of one task; yields finished sequences as lists of pieces."""

    def __init__(self, capacity: int = 2048, classes: int = 32, slack: float = 0.02):
        if capacity < 1 or classes < 2:
            raise ValueError("capacity must be positive and classes at least 2")
        self.capacity, self.classes, self.slack = capacity, min(classes, capacity + 1), slack
        self.bins: dict[int, list[Piece]] = {}
        self.stream: list[Piece] = []
        self.streamed = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        at = 0
        for n in cut_lengths(len(ids), self.capacity, self.classes, self.slack):
            piece = (doc, at, ids[at:at + n])
            at += n
            if n < self.capacity < len(ids):  # it waits; its document's other ids need not
                piece = (doc, piece[1], piece[2].copy())
            j = self.capacity // n
            if j >= self.classes:
                yield from self._lay(piece)
                continue
            held = self.bins.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                yield self.bins.pop(j)

    def _lay(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, ids = piece
        while len(ids):
            n = min(len(ids), self.capacity - self.streamed)
            self.stream.append((doc, start, ids[:n]))
            self.streamed += n
            start, ids = start + n, ids[n:]
            if self.streamed == self.capacity:
                yield self.stream
                self.stream, self.streamed = [], 0

    def finish(self) -> Iterator[list[Piece]]:
        for j in sorted(self.bins):
            for piece in self.bins[j]:
                yield from self._lay(piece)
        self.bins = {}
        rest, left = self.stream, self.streamed
        self.stream, self.streamed = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                doc, start, ids = rest[0]
                n = min(len(ids), room)
                sequence.append((doc, start, ids[:n]))
                room -= n
                rest = ([(doc, start + n, ids[n:])] if n < len(ids) else []) + rest[1:]
            yield sequence


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

#: Texts tokenized at once, and ids sent on at once.
TEXT_BYTES = 1 << 20
IDS_AT_ONCE = 1 << 18


class Rows:
    """Finished pieces of one task, column by column; the ids lie in one flat array."""

    def __init__(self, names: list[str], with_ids: bool):
        self.names, self.with_ids = names, with_ids
        self.columns: list[list] = [[] for _ in range(1 + len(COLUMNS))]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, row: tuple, ids: np.ndarray) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += len(ids)
        if self.with_ids:
            self.ids.append(ids)

    def batch(self, key_type: pa.DataType) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(self.columns, [key_type] + [pa.int64()] * len(COLUMNS))]
        if self.with_ids:
            ends = np.cumsum([0, *map(len, self.ids)])
            flat = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32))))
        self.__init__(self.names, self.with_ids)
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def packed(batches, path: str, packer: Packer, sequence: int, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one task; its sequences are numbered from ``sequence``."""
    encoder, rows = Encoder.of(path), Rows(names, with_ids)
    open_docs: dict[int, list] = {}  # number: [key, tokens, tokens not yet placed]
    number, key_type = 0, pa.null()

    def place(pieces: list[Piece]) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids in pieces:
            info = open_docs[doc]
            rows.add((info[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), info[1], sequence, offset), ids)
            offset += len(ids)
            info[2] -= len(ids)
            if not info[2]:
                del open_docs[doc]
        sequence += 1

    for b in slices(batches, "_packed_text", TEXT_BYTES):
        key_type = b.column("_packed_key").type
        flat, off = encoder.encode(b.column("_packed_text"))
        for key_value, a, z in zip(b.column("_packed_key").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            ids = np.append(flat[a:z], np.uint32(END))
            open_docs[number] = [key_value, len(ids), len(ids)]
            for pieces in packer.add(number, ids):
                place(pieces)
                if rows.size >= IDS_AT_ONCE:
                    yield rows.batch(key_type)
            number += 1
        del flat
        yield rows.batch(key_type)
    encoder.rest()
    for pieces in packer.finish():
        place(pieces)
    if rows.size:
        yield rows.batch(key_type)
    give_back()


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048,
         classes: int = 32, slack: float = 0.02, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, unless ``with_ids`` is off, the token ids themselves.

    Every row of ``docs`` is packed with its whole text and an end id; null or
    empty text is the end id alone.  Rows with a null or repeated key are packed
    each on its own.  Other columns of ``docs`` are left behind.  Empty table: no
    rows.  A task's sequence ids begin with its partition number; a task that is
    run again packs its partition the same way.  Memory: one slice of texts (or one
    longer text), the tokenizer's cache, ``IDS_AT_ONCE`` ids and at most ``classes``
    open bins.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.LongType()) for c in COLUMNS])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    names = schema.names

    def run(batches):
        packer = Packer(capacity, classes, slack)
        yield from packed(batches, tokenizer_path, packer, TaskContext.get().partitionId() << 33, names, with_ids)

    return (docs.select(F.col(f"`{key}`").alias("_packed_key"),
                        F.col(f"`{text}`").cast("string").alias("_packed_text"))
            .mapInArrow(run, schema))
