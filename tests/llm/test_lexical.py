"""Ranked lexical search against a brute-force version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import lexical

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, length = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c, size in held:
            m = 25 + (75 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.schema["rank"].dataType.simpleString() == "int"
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, docs=150, items=24):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÄRGER", "x-y", "don't", "A1"]
    weight = 1 / np.arange(1, len(words) + 1)
    pick = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    rows = [(int(i * 7 % docs), pick(rng.integers(0, 60))) for i in range(docs)]
    rows += rows[:30]  # copies: ties
    return rows, [(int(i), pick(rng.integers(0, 25))) for i in range(items)]


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 5)])
def test_same_ranks_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", block)
    docs, items = corpus(seed)
    assert run(spark, docs, items) == plain(docs, items)


def test_small_batches_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", 7)
    docs, items = corpus(3)
    assert run(spark, docs, items, 3) == plain(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- !"), (4, "the cat"), (4, "the cat"), (None, "the cat"), (5, "THE Cat cat"), (6, "dog " * 50_000), (7, "é\x00É")]
    items = [(1, None), (2, "cat"), (2, "cat"), (3, "cat dog the the"), (None, "dog"), (4, "unknown"), (5, "É")]
    assert run(spark, docs, items) == plain(docs, items)


def test_every_document_has_the_term(spark):
    docs = [(i, "all") for i in range(12)]
    assert run(spark, docs, [(1, "all")]) == plain(docs, [(1, "all")])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], [])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "n", "item_id", "score", "rank")})
    items = spark.createDataFrame([(9, "a")], "item_id long, text string").withColumns({c: F.lit(0) for c in ("item", "number", "block", "doc_id")})
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(9, 1, 1)]


def test_plan_sums_are_the_items_terms():
    """Every item's symbols, taken apart along the DAG, are its term classes."""
    rng = np.random.default_rng(5)
    held = rng.random((40, 30)) < 0.3
    pairs, after = lexical.mine(held)
    assert pairs
    parts = [Counter({s: 1}) for s in range(len(held))]
    for a, b in pairs:
        parts.append(parts[a] + parts[b])
    for j in range(held.shape[1]):
        total = sum((parts[s] for s in np.flatnonzero(after[:, j])), Counter())
        assert total == Counter({s: 1 for s in np.flatnonzero(held[:, j])})
    assert len(pairs) + after.sum() < held.sum()
