"""Quality rules (operator 5): surface counts plus a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are estimated, one from the trusted
target documents and one from the whole raw corpus.  A document's score is the
mean over its n-grams of ``log(p_target / p_raw)``; every document is decided by
the same fixed threshold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.words import slices, split_words, text_bytes, window_hashes
from casebook.session import ship_package

GRAM = 4
BUCKETS = 1 << 16
CHUNK = 1 << 10
#: Share of the raw multinomial mixed into the target's, so that an n-gram the
#: trusted texts happen not to hold costs a bounded amount.
BACKGROUND = 0.05

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LEAD = np.ones(256, bool)  # bytes that begin a code point
LEAD[0x80:0xC0] = False


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` inside each [offsets[i], offsets[i+1])."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(words, word_text: np.ndarray) -> np.ndarray:
    """Per text: lines holding a word that equal an earlier line of the text."""
    n = len(words.counts)
    out = np.zeros(n, np.int64)
    raw, off = words.raw, words.offsets
    if words.codes.size == 0:
        return out
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < raw.size]
    line_text = np.searchsorted(off, starts, side="right") - 1
    ends = np.concatenate([starts[1:], [raw.size]])
    ends = np.minimum(ends, off[line_text + 1])
    closed = (ends > starts) & (raw[np.maximum(ends - 1, 0)] == 0x0A)
    ends = ends - closed
    filled = np.unique(np.searchsorted(starts, words.starts, side="right") - 1)
    data = raw.tobytes()
    seen: set = set()
    for t, s, e in zip(line_text[filled].tolist(), starts[filled].tolist(), ends[filled].tolist()):
        key = (t, data[s:e])
        if key in seen:
            out[t] += 1
        else:
            seen.add(key)
    return out


def repeated_words(words, word_text: np.ndarray) -> np.ndarray:
    """Per text: words inside a 3-word window that the text holds twice or more."""
    n = len(words.counts)
    codes, size = words.codes, 3
    if codes.size < size:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(word_text[:-2] == word_text[2:])
    if at.size == 0:
        return np.zeros(n, np.int64)
    # Exact identity of the windows: rank pairs of codes, then (pair, code, text).
    wide = np.int64(codes.max()) + 1
    _, pair = np.unique(codes[at] * wide + codes[at + 1], return_inverse=True)
    _, triple = np.unique(pair.astype(np.int64) * wide + codes[at + 2], return_inverse=True)
    _, which, count = np.unique(triple.astype(np.int64) * n + word_text[at],
                                return_inverse=True, return_counts=True)
    again = at[count[which] >= 2]
    marked = np.zeros(codes.size, bool)
    for i in range(size):
        marked[again + i] = True
    return np.bincount(word_text[marked], minlength=n)


def surface(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts behind the base rules, for a batch of whole texts."""
    w = split_words(texts)
    word_text = w.text_of_word()
    lead = np.concatenate([[0], np.cumsum(LEAD[w.raw])])
    chars = lead[w.ends] - lead[w.starts] if w.codes.size else np.zeros(0, np.int64)
    return {"n_words": w.counts.astype(np.int64),
            "word_chars": np.bincount(word_text, weights=chars, minlength=len(w.counts)).astype(np.int64),
            "n_symbols": segment_sums(SYMBOL[w.raw], w.offsets).astype(np.int64),
            "n_dup_lines": repeated_lines(w, word_text),
            "n_repeat_words": repeated_words(w, word_text).astype(np.int64)}


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram inside one text, and the n-grams per text."""
    raw, off = text_bytes(texts)
    n = raw.size - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    wide = raw.astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    for i in range(GRAM):
        gram = (gram << np.uint32(8)) | wide[i:n + i]
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = np.zeros(raw.size + 1, bool)
    inside[:n] = True
    for i in range(1, GRAM):  # grams that would cross into the next text
        last = off[1:] - i
        inside[last[last >= off[:-1]]] = False
    short = np.minimum(off[1:] - off[:-1], GRAM - 1)
    per_text = (off[1:] - off[:-1]) - short
    return bucket[inside[:n]], per_text


@dataclass
class Ratio:
    """Log ratio of each bucket and the threshold on a document's mean."""
    log_ratio: np.ndarray
    threshold: float

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, per_text = gram_buckets(texts)
        off = np.concatenate([[0], np.cumsum(per_text)])
        return segment_sums(self.log_ratio[bucket], off) / np.maximum(per_text, 1)


def gram_counts(docs: DataFrame, text: str = "text", trusted: str = "trusted") -> np.ndarray:
    """Exact n-gram counts over all documents: row 0 the raw corpus, row 1 the
    trusted ones.  Each task sends its two count vectors in compressed pieces of
    ``CHUNK`` buckets; the sum is a fixed ``2 x BUCKETS`` table whatever the input."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for b in slices(batches, "text"):
            bucket, per_text = gram_buckets(b.column("text"))
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            mine = np.repeat(b.column("trusted").to_numpy(zero_copy_only=False).astype(bool), per_text)
            total[1] += np.bincount(bucket[mine], minlength=BUCKETS)
        parts = total.reshape(2 * BUCKETS // CHUNK, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()),
             pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())],
            names=["part", "counts"])

    def add(key, table):
        total = np.zeros(CHUNK, np.int64)
        for v in table["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(v), np.int64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                         "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    rows = (docs.select(F.col(text).cast("string").alias("text"), F.col(trusted).cast("boolean").alias("trusted"))
            .mapInArrow(count, "part int, counts binary")
            .groupBy("part").applyInArrow(add, "part int, counts array<long>").collect())
    out = np.zeros((2 * BUCKETS // CHUNK, CHUNK), np.int64)
    for r in rows:
        out[r["part"]] = r["counts"]
    return out.reshape(2, BUCKETS)


def fit_ratio(docs: DataFrame, trusted: Column, tolerance: float = 0.5) -> Ratio:
    """Estimate the two multinomials over all of ``docs`` and set the threshold.

    The threshold is ``-tolerance`` nats per n-gram: a text whose n-grams are that
    much likelier under the raw corpus than under the trusted target is rejected.
    It does not depend on the table's order, size or partitioning.  Without any
    trusted text the ratio is 0 everywhere and nothing is rejected.
    """
    raw, target = gram_counts(docs.withColumn("trusted", trusted))
    if target.sum() == 0:
        return Ratio(np.zeros(BUCKETS), -tolerance)
    q = (raw + 1.0) / (raw.sum() + BUCKETS)
    p = (1 - BACKGROUND) * target / target.sum() + BACKGROUND * q
    return Ratio(np.log(p) - np.log(q), -tolerance)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "ratio", "base_failed", "kept")


def judge(docs: DataFrame, ratio: Ratio, text: str = "text",
          min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Every document with its counts, ratio, base_failed and kept.

    Null text counts as empty (0 words, so base_failed).  One row out per row in;
    columns of ``docs`` named like an added one are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = [c for c in docs.columns if c not in ADDED]
    shared = spark.sparkContext.broadcast((ratio.log_ratio, ratio.threshold))
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    for c in COUNTS:
        schema = schema.add(c, T.LongType())
    schema = schema.add("ratio", T.DoubleType()).add("base_failed", T.BooleanType()).add("kept", T.BooleanType())

    def run(batches):
        model = Ratio(*shared.value)
        for b in slices(batches, "_judged_text"):
            texts = b.column("_judged_text")
            s = surface(texts)
            score = model.score(texts)
            failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
            good = ~failed & (score >= model.threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(s[c], pa.int64()) for c in COUNTS]
                + [pa.array(score, pa.float64()), pa.array(failed), pa.array(good)], names=[*kept, *ADDED])

    return (docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_judged_text"))
            .mapInArrow(run, schema))


def with_trust(docs: DataFrame, labels: DataFrame, max_trusted: int = 100_000) -> DataFrame:
    """``docs`` plus ``trusted``: labelled as good quality and not toxic.

    Labels are first reduced to one row per doc_id (repeated labels: trusted only
    if all agree); null ids match nothing.  The target model is fitted on at most
    ``max_trusted`` of the trusted ids, those with the smallest hash, so the id
    list that is broadcast is bounded; the raw model and every decision cover all
    documents.
    """
    fine = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(fine).alias("trusted"))
            .where("trusted").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted))
    return (docs.drop("trusted").join(F.broadcast(good), "doc_id", "left")
            .withColumn("trusted", F.coalesce("trusted", F.lit(False))))
