"""Greedy word-piece lengths by a linear longest-match automaton (operator 10).

The vocabulary is a trie over bytes.  Every node carries a failure link and the
number of pieces that leave the word when that link is taken, so a word is read
once, byte by byte, and only counted: no piece is ever built.  The automaton runs
in lock step over all distinct words of a batch with numpy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.words import slices, split_words
from casebook.session import ship_package


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


def load_vocabulary(path: str) -> list[bytes]:
    """The ordinary tokens of a byte-level tokenizer file, as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    to_byte = byte_alphabet()
    return [bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


@dataclass
class Automaton:
    """Trie edges as one sorted array ``node * 256 + byte``; per node the failure
    link, the pieces popped by it, and the pieces left when the word ends there."""
    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    at_end: np.ndarray

    @classmethod
    def build(cls, vocabulary: list[bytes]) -> Automaton:
        """``vocabulary`` must hold all 256 single bytes, so every word has pieces."""
        if len({t for t in vocabulary if len(t) == 1}) < 256:
            raise ValueError("the vocabulary must hold every single byte")
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for token in vocabulary:
            at = 0
            for b in token:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = len(children)
                    children[at][b] = nxt
                    children.append({})
                    whole.append(False)
                at = nxt
            whole[at] = bool(token)
        n = len(children)
        fail, popped, at_end = [0] * n, [0] * n, [0] * n
        level = [0]
        while level:  # breadth first: a node's link only needs shallower nodes
            below = []
            for u in level:
                for b, v in children[u].items():
                    if whole[v]:
                        fail[v], popped[v] = 0, 1
                    else:
                        z, count = fail[u], popped[u]
                        while b not in children[z]:
                            count += popped[z]
                            z = fail[z]
                        fail[v], popped[v] = children[z][b], count
                    at_end[v] = popped[v] + at_end[fail[v]]
                    below.append(v)
            level = below
        pairs = sorted((u << 8 | b, v) for u in range(n) for b, v in children[u].items())
        edges, targets = zip(*pairs)
        return cls(*(np.array(x, np.int64) for x in (edges, targets, fail, popped, at_end)))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words advancing one byte at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        node = np.zeros(len(words), np.int64)
        pieces = np.zeros(len(words), np.int64)
        active = len(words)
        for step in range(int(sorted_lengths[0]) if len(words) else 0):
            active = int(np.searchsorted(-sorted_lengths[:active], -step, side="left"))
            byte = data[begin[:active] + step].astype(np.int64)
            todo = np.arange(active)
            while todo.size:
                key = (node[todo] << 8) | byte[todo]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                stepped = self.edges[at] == key
                node[todo[stepped]] = self.targets[at[stepped]]
                todo = todo[~stepped]
                pieces[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
        out = np.zeros(len(words), np.int64)
        out[order] = pieces + self.at_end[node]
        return out


def greedy_pieces(word: bytes, vocabulary: set[bytes]) -> list[bytes]:
    """The plain definition, for tests: the longest token first, again and again."""
    out, longest = [], max(map(len, vocabulary))
    while word:
        n = next(n for n in range(min(longest, len(word)), 0, -1) if word[:n] in vocabulary)
        out.append(word[:n])
        word = word[n:]
    return out


ADDED = ("n_words", "n_pieces", "max_pieces")


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Every document with n_words, n_pieces (greedy longest-match pieces of all its
    words) and max_pieces (of its longest word).

    A word is a run without space or U+0009..U+000D; it is matched with one
    leading space, which marks the beginning of a word in the vocabulary.  Whole
    texts are read.  Null or blank text: zeros.  One row out per row in; columns
    of ``docs`` named like an added one are replaced.  The vocabulary (a fixed
    file of some 50,000 tokens) is broadcast, and each task builds the
    automaton.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = [c for c in docs.columns if c not in ADDED]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    for c in ADDED:
        schema = schema.add(c, T.LongType())

    def run(batches):
        automaton = Automaton.build(shared.value)
        for b in slices(batches, "_counted_text"):
            w = split_words(b.column("_counted_text"))
            used, code = np.unique(w.codes, return_inverse=True)
            words = [b" " + x for x in w.vocab.take(pa.array(used)).to_pylist()] if used.size else []
            each = automaton.count(words)[code] if used.size else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(each)])
            bounds = w.bounds
            most = np.zeros(len(w.counts), np.int64)
            np.maximum.at(most, w.text_of_word(), each)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in
                                               (w.counts, total[bounds[1:]] - total[bounds[:-1]], most)],
                names=[*kept, *ADDED])

    return (docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_counted_text"))
            .mapInArrow(run, schema))
