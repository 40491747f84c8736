"""Operators 3, 6 and 7 (DataFrame functions only) and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from casebook.llm import line_dedup, mixing, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_python(df):
    return not re.search("Python|Pandas|Arrow", plan(df))


# ---- 3 line dedup

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def plain_removed(rows, threshold, min_chars):
    """Per row (id, text): numbers of the lines that go."""
    def order(i, no):
        k, t = rows[i]
        return (k is not None, k or 0, t, no)

    places = [(order(i, no), line, i, no) for i, (_, t) in enumerate(rows) if t is not None
              for no, line in enumerate(t.split("\n")) if len(line) >= min_chars]
    first = {}
    for at, line, _, _ in sorted(places):
        first.setdefault(line, at)
    late = {x for x, y in itertools.permutations(first, 2)
            if abs(len(x) - len(y)) <= threshold and first[y] < first[x] and edit_distance(x, y) <= threshold}
    out = defaultdict(set)
    for at, line, i, no in places:
        if line in late or at != first[line]:
            out[i].add(no)
    return out


def line_rows():
    random.seed(8)
    base = ["".join(random.choices("abcdeé ", k=random.randint(6, 14))) for _ in range(12)]

    def edited(s):
        s = list(s)
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(s))
            kind = random.random()
            if kind < .33:
                s.insert(at, random.choice("abx"))
            elif at < len(s):
                s[at:at + 1] = [] if kind < .66 else ["z"]
        return "".join(s)

    rows = [(i, "\n".join(edited(random.choice(base)) for _ in range(random.randint(1, 5)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, base[0] + "\n" + base[0]), (53, "short"), (54, base[1] + "\n"),
             (55, base[2] * 20), (56, base[2] * 20 + "q"), (2, "the same row twice"), (2, "the same row twice"), (2, "other text")]
    return rows


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_line_dedup(spark, threshold):
    rows = line_rows() if threshold == 2 else [r for r in line_rows() if len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, n_lines string")
    got = line_dedup.dedup_lines(docs, threshold, min_chars=5).collect()
    gone = plain_removed(rows, threshold, 5)
    expected = []
    for i, (k, t) in enumerate(rows):
        lines = None if t is None else t.split("\n")
        text = t if not gone[i] else "\n".join(x for no, x in enumerate(lines) if no not in gone[i])
        expected.append((k, text, len(lines or []), sorted(gone[i])))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.removed_lines) for r in got), key=str) == sorted(expected, key=str)


def test_within_equals_edit_distance(spark):
    random.seed(1)
    pairs = [("".join(random.choices("abé", k=random.randint(0, 9))), "".join(random.choices("abé", k=random.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    split = lambda c: F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))
    for t in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within(split("a"), split("b"), t).alias("w")).collect()
        assert all(r.w == (edit_distance(r.a, r.b) <= t) for r in got)


def test_long_lines_are_compared_whole(spark):
    long = "abcdefghij" * 4000
    docs = spark.createDataFrame([(1, long), (2, long[:30000] + "X" + long[30001:]), (3, long[:20000] + "XYZ" + long[20003:])],
                                 "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_line_dedup_is_native_and_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert no_python(line_dedup.dedup_lines(docs))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# ---- 6 sharding

def check_shards(rows, got, shards, tolerance):
    assert Counter((k, t or "") for k, t in rows) == Counter((r.doc_id, r.text or "") for r in got)
    by = defaultdict(list)
    for r in got:
        text = (r.text or "").encode()
        assert r["size"] == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r["size"] for r in got)
    largest = max(Counter((r.doc_id, r.text or "") for r in got for _ in range(r["size"])).values())
    for s in range(shards):
        size = sum(r["size"] for r in by[s])
        assert abs(size - total / shards) <= 2 * (tolerance * total / shards + largest)
    # Equal texts stand in neighbouring shards.
    homes = defaultdict(set)
    for r in got:
        homes[r.text or ""].add(r.shard)
    for h in homes.values():
        assert h == set(range(min(h), max(h) + 1)) or any(not by[s] for s in range(min(h), max(h)))


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = sharding.shard(docs, 24, bucket_rows=3)
    assert no_python(out)
    check_shards([(r.doc_id, r.text) for r in docs.collect()], out.collect(), 24, 0.001)


def test_sharding_hot_group_and_odd_rows(spark):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, "t" * (i % 40)) for i in range(300)]
    rows += [(None, None), (None, None), (5, ""), (5, ""), (7, "x" * 2000)]
    docs = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, slot int")
    got = sharding.shard(docs, 5).collect()
    check_shards(rows, got, 5, 0.001)
    assert len({r.shard for r in got if r.text == "the same text"}) > 1
    empty = docs.limit(0)
    assert sharding.shard(empty, 5).count() == 0
    one = sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 24).collect()
    assert [r.slot for r in one] == [0]


# ---- 7 mixing

def test_mixing_follows_its_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    out = mixing.mix(docs, repeat_limit=1.5, block_docs=16)
    assert no_python(out)
    got = out.collect()
    rows = {r.doc_id: r for r in docs.collect()}
    tokens = {k: len(WORD.findall(r.text or "")) for k, r in rows.items()}
    total = Counter()
    for k, r in rows.items():
        total[r.source] += tokens[k]
    n = sum(total.values())
    a = got[0].exponent
    z = sum((t / n) ** a for t in total.values())
    weight = {s: (t / n) ** a / z for s, t in total.items()}
    # the limit binds
    repeat = {s: (total[s] / max(total.values())) ** (a - 1) for s in total}
    assert max(repeat.values()) <= 1.5 + 1e-9 and max(repeat.values()) > 1.4999
    shown, passes = Counter(), defaultdict(list)
    for r in got:
        assert r.tokens == tokens[r.doc_id] and math.isclose(r.weight, weight[r.source], rel_tol=1e-9)
        shown[r.source] += r.tokens
        passes[r.source, r.epoch].append(r)
    budget = max(total[s] / weight[s] for s in total)
    for s in total:
        whole = passes[s, 0]
        assert len(whole) == len({r.doc_id for r in whole}) == sum(r.source == s for r in rows.values())
        part = sorted(passes.get((s, 1), []), key=lambda r: (r.block_order, r.place_order))
        rest = weight[s] * budget - total[s]
        everything = sorted(whole, key=lambda r: r.doc_id)
        assert sum(r.tokens for r in part) <= rest + 1e-6
        left = [tokens[r.doc_id] for r in everything if r.doc_id not in {x.doc_id for x in part}]
        assert not left or rest - sum(r.tokens for r in part) <= max(left) + 1
        # a block is in one piece, in another order than the first pass
        blocks = [k for k, _ in itertools.groupby(r.block_order for r in part)]
        assert len(blocks) == len(set(blocks))
    assert max(shown.values()) == shown[max(total, key=total.get)]


def test_mixing_entropy_target_and_odd_rows(spark):
    rows = [(i, "a", "x y z") for i in range(60)] + [(100 + i, "b", "x") for i in range(20)] + [(200, None, "q r"), (201, "c", None), (202, "c", " "), (202, "c", " ")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, source string, text string, epoch string")
    flat = mixing.mix(docs, repeat_limit=None, target_entropy=None).collect()
    assert flat[0].exponent == 0.0
    tokens = Counter()
    for r in flat:
        tokens[r.source] += r.tokens
    assert tokens["a"] == 180 and 170 <= tokens["b"] <= 180 and 178 <= tokens[None] <= 180
    target = 0.5
    got = mixing.mix(docs, repeat_limit=None, target_entropy=target).collect()
    w = {r.source: r.weight for r in got if r.weight > 0}
    assert abs(-sum(x * math.log(x) for x in w.values()) - target) < 1e-6
    assert Counter(r.doc_id for r in got)[202] == 2 and Counter(r.doc_id for r in got)[201] == 1
    small = mixing.mix(docs, repeat_limit=1.0, budget=30).collect()
    assert sum(r.tokens for r in small) <= 30
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("source = 'c'")).count() == 3


# ---- pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
            assert out.count() > 0
        at = out
    assert at.count() > 0


def test_pipeline_takes_odd_rows(spark):
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 300), (2, text, "en", "s", 300), (3, None, None, None, None), (None, text + " tail", "en", None, 5), (4, "", "", "", 0), (1, text, "en", "s", 300)]
    for data in (rows, []):
        at = spark.createDataFrame(data, kind)
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        at.collect()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
