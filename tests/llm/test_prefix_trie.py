"""The prefix trie against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casebook.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def first(x):
    return (x is not None, x)


def plain(rows, graft=True, group=20, most=4):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((first(t) if t is not None else (False, 0), r or "", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(v)] for c, v in said.items()}
    if graft:
        def rebuilt(c):
            h = zlib.crc32(str(c).encode()) % most
            base = c - int(c - group * int(c / group))
            return said.get(base, [])[:h] + said[c][h:]
        said = {c: rebuilt(c) for c in said}
    members = defaultdict(list)
    for c, v in said.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def words(p):
        return len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[q][0] for q in children[p]) if children[p] else 1
        saved = (len(members[p]) - 1) * words(p) + sum(sums[q][1] for q in children[p])
        sums[p] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(said[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, block=4):
    turns = trie.stored(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)), "t")
    convs, turns = trie.regrafted(turns)
    found = trie.prefix_trie(convs, turns, block)
    assert found.columns == trie.OUT
    return sorted((tuple(r) for r in found.collect()), key=str)


def talks(seed, convs=90, words=("a", "b c", "b", " ", "")):
    rnd = random.Random(seed)
    rows = []
    for c in range(-25, convs):
        if rnd.random() < 0.8:
            for t in range(rnd.randrange(0, 9)):
                rows.append((c, rnd.choice([None, 0, 1, 2, t, t + 3]), rnd.choice(["user", "assistant", None]), rnd.choice([*words, None])))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 1), (3, 3), (4, 8)])
def test_same_nodes_as_brute_force(spark, seed, block):
    """Null turns, roles and texts, ties, repeated rows, negative ids, missing bases."""
    rows = talks(seed)
    assert built(spark, rows, block) == plain(rows)


def test_deep_nesting_and_long_conversations(spark, monkeypatch):
    """Each conversation goes one turn further; two are longer than a chunk."""
    monkeypatch.setattr(trie, "CHUNK", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c * 20, t, "user", f"t{t}" if t < 37 - c else f"own {c} {t}") for c in range(12) for t in range(40)]
    rows += [(1000 + 20 * c, 0, "user", "hi") for c in range(30)] + [(2000, t, "user", "hi") for t in range(90)]
    assert built(spark, rows) == plain(rows)


def test_turnless_conversations_and_nulls(spark):
    rows = [(21, 0, "user", "x"), (42, 0, "user", "y"), (None, 0, "user", "lost"), (63, 0, "u", "z"), (63, 1, "u", "z")]
    found = built(spark, rows)
    assert found == plain(rows)
    assert sum(r[3] for r in found if r[1] == 0) == 3


def test_empty_table(spark):
    assert built(spark, []) == []


def test_without_grafts_nodes_carry_their_texts(spark):
    """The general operator, over clashing column names and another key type."""
    rows = [(1, 0, "u", "hello"), (1, 1, "a", "there"), (2, 0, "u", "hello"), (2, 1, "a", "you")]
    df = spark.createDataFrame(rows, "id int, at int, who string, said string").withColumns({c: F.lit(1) for c in ("conv", "pos", "n", "words", "depth")})
    found = trie.conversation_trie(df, "id", "at", "who", "said")
    got = {(r["conv_id"], r["depth"]): (r["n_convs"], r["role"], r["text"], r["saved_tokens"]) for r in found.collect()}
    assert got == {(1, 0): (2, None, None, 1), (1, 1): (2, "u", "hello", 1), (1, 2): (1, "a", "there", 0), (2, 2): (1, "a", "you", 0)}
