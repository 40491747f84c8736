"""Ranked lexical search of many queries at once (operator 12).

The queries ("items") are taken in blocks of bounded size.  In a block, terms that the
same items hold the same number of times form one class.  A greedy pass over the
classes mines shared sets: the two symbols that most items have in common become one
new symbol, until no two items share a pair.  The result is a DAG of sums: every
symbol is a class or the sum of two earlier symbols, every item the sum of a few.

Two passes follow.  The first reads the texts once and keeps, per document, its length
and the counts of the block's terms; document frequencies and lengths are counted from
there.  The second computes each document's partial score per class once, adds them up
along the DAG for all items together, and keeps the best of every task; the tasks'
lists are merged at the end.  All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.indexing import dense_index
from casebook.llm.scratch import shared_path, stored
from casebook.llm.words import slices, split_words
from casebook.session import ship_package

#: Bytes of a term: ASCII letters and digits, and everything beyond ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

ITEMS_AT_ONCE = 256
DOCS_AT_ONCE = 1024
SUMS_AT_ONCE = 2_000_000
B = 75


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, block, term, n): the terms of every item with a term, as bytes."""
    def run(batches):
        for b in slices(batches, "text"):
            w = split_words(b.column("text"), lower=True, keep=IS_TERM)
            at = w.text_of_word() * max(len(w.vocab), 1) + w.codes
            pair, n = np.unique(at, return_counts=True)
            item, code = pair // max(len(w.vocab), 1), pair % max(len(w.vocab), 1)
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(item)), w.vocab.take(pa.array(code)), pa.array(n)],
                                             names=["item", "term", "n"])

    asked = items.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    # Items of the same id are one query each; they are told apart by their number.
    asked = dense_index(asked, ["item", "text"], "number")
    kinds = asked.select(F.col("number").alias("item"), "text").mapInArrow(run, "item long, term binary, n long")
    ids = asked.select(F.col("number"), F.col("item").alias("id"))
    return stored(kinds.join(ids.withColumnRenamed("number", "item"), "item")
                  .withColumn("block", F.floor(F.col("item") / ITEMS_AT_ONCE)), "lex-items")


@dataclass
class Plan:
    """The sums of one block of items.  The first symbols are term classes, each with the
    number of times it counts; the later ones are the sum of the two symbols in
    ``pairs``.  ``parts`` lists, item by item, the symbols to add."""
    items: np.ndarray          # number of each item in the block
    ids: list                  # its id, may be None
    terms: pa.Array            # distinct terms, sorted
    class_of: np.ndarray       # class of each term
    classes: int
    pairs: list[tuple[int, int]]
    parts: list[list[int]]
    times: list[dict]          # of each class: item -> how often it holds the terms


def mine(held: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Greedy common subexpressions of the rows of ``held`` (symbol x item, boolean):
    (pairs, held of all symbols afterwards).  Each item is the sum of its symbols."""
    size = len(held)
    # Every new symbol takes at least two memberships away.
    rows = np.zeros((size + int(held.sum()) // 2 + 1, held.shape[1]), np.float32)
    rows[:size] = held
    pairs: list[tuple[int, int]] = []
    best, mate = np.zeros(len(rows)), np.zeros(len(rows), np.int64)

    def look(i: int) -> None:
        shared = rows[:size] @ rows[i]
        shared[i] = 0
        mate[i] = int(np.argmax(shared)) if size else 0
        best[i] = shared[mate[i]] if size else 0

    for i in range(size):
        look(i)
    while size:
        i = int(np.argmax(best[:size]))
        if best[i] < 2:
            break
        before = best[i]
        look(i)  # what it was when last looked at is an upper bound
        if best[i] < before:
            continue
        a, b = i, int(mate[i])
        both = rows[a] * rows[b]
        rows[a] -= both
        rows[b] -= both
        rows[size] = both
        pairs.append((min(a, b), max(a, b)))
        size += 1
        for x in (a, b, size - 1):
            look(x)
    return pairs, rows[:size] > 0


def plan_of(rows: pa.Table) -> tuple[Plan, list[tuple[int, int]]]:
    """The plan of one block, from its (item, id, term, n) rows, and its first symbols:
    (class, how often it counts)."""
    items, first = np.unique(rows["item"].to_numpy(), return_index=True)
    ids = rows["id"].take(pa.array(first)).to_pylist()
    coded = rows["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    order = np.lexsort((rows["item"].to_numpy(), code))
    code, item, n = code[order], np.searchsorted(items, rows["item"].to_numpy()[order]), rows["n"].to_numpy()[order]
    cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
    found: dict[tuple, int] = {}
    class_of = np.zeros(len(terms), np.int64)
    for a, z in zip(cuts[:-1], cuts[1:]):
        held = (tuple(item[a:z].tolist()), tuple(n[a:z].tolist()))
        class_of[code[a]] = found.setdefault(held, len(found))
    # A class that an item holds twice enters it twice as a symbol of its own weight.
    symbols, held, times = [], [], []
    for (who, often), c in found.items():
        times.append(dict(zip(who, often)))
        for k in sorted(set(often)):
            row = np.zeros(len(items), bool)
            row[[w for w, o in zip(who, often) if o == k]] = True
            symbols.append((c, k))
            held.append(row)
    pairs, after = mine(np.array(held) if held else np.zeros((0, len(items)), bool))
    parts = [np.flatnonzero(after[:, j]).tolist() for j in range(len(items))]
    return Plan(items, ids, terms, class_of, len(found), pairs, parts, times), symbols


def term_counts(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """(id, n, terms, tf) of every document with a term: its length in terms, and the
    numbers and counts of those in ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.to_pylist())

    def run(batches):
        listed = pa.array(shared.value, pa.binary())
        for b in slices(batches, "text"):
            w = split_words(b.column("text"), lower=True, keep=IS_TERM)
            some = np.flatnonzero(w.counts > 0)
            number = pc.fill_null(pc.index_in(w.vocab, value_set=listed), -1).to_numpy().astype(np.int64)
            code = number[w.codes] if len(w.codes) else np.zeros(0, np.int64)
            text = w.text_of_word()
            pair, tf = np.unique(text[code >= 0] * max(len(listed), 1) + code[code >= 0], return_counts=True)
            at = np.searchsorted(pair, np.append(some, b.num_rows) * max(len(listed), 1))
            at[-1] = len(pair)
            offsets = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(some)), pa.array(w.counts[some]),
                 pa.ListArray.from_arrays(offsets, pa.array((pair % max(len(listed), 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


def weights_of(counts: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """(w of each term, N, L).  The rows collected are at most the block's terms."""
    n, length = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    w = np.zeros(terms, np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        w[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return w, n, length or 0


def best_of(scores: np.ndarray, ids: np.ndarray, k: int):
    """(item, place) of the ``k`` best scores above 0 of each row; ``ids`` ascend."""
    if scores.shape[1] > k:
        # Only what reaches the k-th score can be among the best.
        floor = np.partition(scores, -k, axis=1)[:, -k]
        item, place = np.nonzero((scores >= np.maximum(floor, 1)[:, None]))
    else:
        item, place = np.nonzero(scores > 0)
    order = np.lexsort((place, -scores[item, place], item))
    item, place = item[order], place[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return item[rank < k], place[rank < k]


def ranked(counts: DataFrame, plan: Plan, symbols: list, w: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """(item, id, score) of the best ``k`` documents of each item in every task."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((plan.pairs, plan.parts, plan.class_of, plan.classes, symbols, w))
    numbers = plan.items

    def run(batches):
        pairs, parts, class_of, classes, symbols, w = shared.value
        held = np.zeros((0, 3), np.int64)  # item, id, score
        none = np.zeros(0, bool)
        docs = max(16, min(DOCS_AT_ONCE, SUMS_AT_ONCE // max(classes + len(symbols) + len(pairs), 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, docs):
                b = batch.slice(start, docs)
                known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(b.column("id"), 0).to_numpy()
                order = np.lexsort((ids, ~known))
                b, ids, known = b.take(pa.array(order)), ids[order], known[order]
                m = 100 - B + (B * b.column("n").to_numpy() * n) // length
                tf = b.column("tf").flatten().to_numpy().astype(np.int64)
                term = b.column("terms").flatten().to_numpy()
                size = pc.list_value_length(b.column("terms")).to_numpy()
                doc = np.repeat(np.arange(b.num_rows), size)
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                partial = np.zeros((classes, b.num_rows), np.int64)
                np.add.at(partial, (class_of[term], doc), gain)
                sums = np.zeros((len(symbols) + len(pairs), b.num_rows), np.int64)
                for s, (c, times) in enumerate(symbols):
                    np.multiply(partial[c], times, out=sums[s])
                for s, (x, y) in enumerate(pairs, len(symbols)):
                    np.add(sums[x], sums[y], out=sums[s])
                scores = np.zeros((len(parts), b.num_rows), np.int64)
                for j, own in enumerate(parts):
                    for s in own:
                        scores[j] += sums[s]
                item, place = best_of(scores, ids, k)
                held = np.concatenate([held, np.stack([item, ids[place], scores[item, place]], 1)])
                none = np.concatenate([none, ~known[place]])
                order = np.lexsort((held[:, 1], none, -held[:, 2], held[:, 0]))
                held, none = held[order], none[order]
                rank = np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0])
                held, none = held[rank < k], none[rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[held[:, 0]]), pa.array(held[:, 1], mask=none), pa.array(held[:, 2])],
                                         names=["item", "id", "score"])

    return counts.mapInArrow(run, "item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (int, from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased.  With N documents that hold a term, L terms in them, n in one, df
    documents with a term and tf times in one: w = floor(1000 ln((2N+2) / (2df+1))),
    m = 25 + 75 n N div L, and the score is the sum over the item's terms, repeats
    included, of w * (10^9 tf div (1000 tf + 8 m)).  Only scores above 0 are listed; equal
    scores go by ascending doc_id, a null one last.  Null or empty texts have no terms;
    an item without terms or matches has no rows.  Repeated rows are documents (or items)
    of their own.  Other columns are not read.  Items are answered ``ITEMS_AT_ONCE`` at a
    time, each block in two passes over the documents, so what is broadcast is bounded by
    the terms of that many items.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = item_terms(items, item, item_text)
    folder, done = shared_path(spark, "lex-found"), False
    for block in sorted(r[0] for r in asked.select("block").distinct().collect()):
        plan, symbols = plan_of(asked.where(F.col("block") == block).select("item", "id", "term", "n").toArrow())
        counts = stored(term_counts(docs, plan.terms), "lex-counts")
        w, n, length = weights_of(counts, len(plan.terms))
        if not n:
            continue
        names = spark.createDataFrame([(int(x), y) for x, y in zip(plan.items, plan.ids)], "item long, item_id long")
        found = ranked(counts, plan, symbols, w, n, length, k).join(F.broadcast(names), "item")
        found.select("item_id", F.col("item").alias("number"), "id", "score").write.mode("append").parquet(folder)
        done = True
    schema = "item_id long, number long, id long, score long"
    out = spark.read.schema(schema).parquet(folder) if done else spark.createDataFrame([], schema)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", F.col("id").alias("doc_id"), "score"))


def sharing(plan: Plan, symbols: list) -> dict[str, int]:
    """Additions for one document with and without the DAG."""
    apart = sum(sum(t.values()) for t in plan.times)
    return {"items": len(plan.items), "terms": len(plan.terms), "classes": plan.classes, "nodes": len(plan.pairs),
            "sums_apart": apart, "sums_shared": len(symbols) + len(plan.pairs) + sum(map(len, plan.parts))}
