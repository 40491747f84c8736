"""Every stage of the corpus pipeline against a plain version of it, on one small corpus."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from casebook.llm import quality
from casebook.llm.queries import tokenizer_path
from casebook.llm.tokenize import Encoder
from tests.llm.test_line_lengths import plain as plain_lines
from tests.llm.test_llm_python import plain_components, plain_surface

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Texts of two kinds of words, exact and near copies, shared lines, short and repetitive texts."""
    rnd = random.Random(12)
    kinds = [["lorem", "ipsum", "dolor", "sit", "amet", "tempor"], ["qzx", "xxq", "zqz", "kkx", "jqj", "wvz"]]

    def text(kind, lines):
        return "\n".join(" ".join(rnd.choice(kinds[kind]) + str(rnd.randrange(40)) for _ in range(rnd.randint(6, 14))) for _ in range(lines))

    shared = text(0, 1)
    texts = [text(0, rnd.randint(7, 12)) for _ in range(24)] + [text(1, 9) for _ in range(6)]
    texts += [texts[0], texts[0], texts[1].replace("ipsum", "ipsun", 1), texts[2] + "\n" + shared, texts[3] + "\n" + shared, "short",
              "", None, "word " * 80, texts[4] + " more", shared + "\n" + text(0, 8), text(0, 8) + "\n" + shared[:-1] + "x"]
    rows = [(i, t, "en", "ab"[i % 5 == 0], len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 24), int(i == 5)) for i in range(0, len(rows), 2)]
    return rows, labels


def plain_quality(rows, labels):
    """Base rules and the byte 4-gram ratio, gram by gram."""
    good = {i for i, q, t in labels if q == 1 and t == 0}

    def buckets(text):
        raw = (text or "").encode()
        return [((int.from_bytes(raw[k:k + 4], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for k in range(len(raw) - 3)]

    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    n, m = sum(raw.values()), sum(target.values())

    def ratio(g):
        q = (raw[g] + 1) / (n + quality.BUCKETS)
        return math.log((1 - quality.BACKGROUND) * target[g] / m + quality.BACKGROUND * q) - math.log(q)

    out = {}
    for i, t, *_ in rows:
        words, _, _, _, again = plain_surface(t)
        grams = buckets(t)
        score = sum(map(ratio, grams)) / max(1, len(grams))
        out[i] = (score, words >= 50 and 100 * again <= 50 * words and score >= -0.5)
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, labels = corpus()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.createDataFrame(rows, SCHEMA), {"documents": rows}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder), f"stage-{name}")
        out[name] = [tuple(r) for r in docs.collect()]
    out["ids"] = docs.columns
    out["ratio"] = {r["doc_id"]: r["ratio"] for r in quality.judge(
        spark.createDataFrame(rows, SCHEMA), quality.fit_ratio(quality.with_trust(
            spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
            pipeline.F.col("trusted"))).collect()}
    return out, labels


def test_quality_stage(stages):
    out, labels = stages
    want = plain_quality(out["documents"], labels)
    assert sorted(out["quality_rules"]) == sorted(r for r in out["documents"] if want[r[0]][1])
    assert 20 < len(out["quality_rules"]) < len(out["documents"])
    assert all(abs(out["ratio"][i] - s) < 1e-9 for i, (s, _) in want.items())


def test_line_stage(stages):
    rows = out = stages[0]["quality_rules"]
    gone = plain_lines([(r[0], r[1]) for r in rows], 2, 10)
    want = []
    for k, (i, t, lang, source, n) in enumerate(rows):
        if gone[k]:
            t = "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[k])
            n = len(t)
        if t.split():
            want.append((i, t, lang, source, n))
    assert sorted(stages[0]["line_dedup"]) == sorted(want) and sorted(want) != sorted(out)


def test_jaccard_stage(stages):
    rows = stages[0]["line_dedup"]
    root = {k: c for k, _, c in plain_components([(r[0], r[1]) for r in rows], 5, 80)}
    assert sorted(stages[0]["ngram_jaccard_join"]) == sorted(r for r in rows if root[r[0]] == r[0])


def test_mixing_stage(stages):
    """Every document at least once and only whole rows; sources repeated at most 1.5 times on average."""
    before, after = Counter(stages[0]["ngram_jaccard_join"]), Counter(stages[0]["source_mixing"])
    assert set(before) == set(after) and all(after[r] >= before[r] for r in before)
    words = defaultdict(lambda: [0, 0])
    for r in before:
        words[r[3]][0] += before[r] * len(r[1].split())
        words[r[3]][1] += after[r] * len(r[1].split())
    longest = max(len(r[1].split()) for r in before)
    assert all(b <= 1.5 * a + 2 * longest for a, b in words.values())
    assert any(b > a for a, b in words.values())


def test_packing_stage(stages):
    docs, columns = stages[0]["source_mixing"], stages[0]["ids"]
    pieces = [dict(zip(columns, r)) for r in stages[0]["packing"]]
    encoder = Encoder(tokenizer_path()).tokenizer
    ids = {r[0]: encoder.encode(r[1], add_special_tokens=False).ids + [1] for r in docs}
    times, covered, sequences = Counter(r[0] for r in docs), defaultdict(Counter), defaultdict(list)
    for p in pieces:
        whole = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(whole) and list(p["ids"]) == whole[p["start"]:p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p["ids"]))
        covered[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(covered) == set(ids)
    assert all(set(covered[i].values()) == {times[i]} and len(covered[i]) == len(ids[i]) for i in ids)
    for s in sequences.values():
        ends = 0
        for at, n in sorted(s):
            assert at == ends
            ends += n
        assert ends <= 2048
