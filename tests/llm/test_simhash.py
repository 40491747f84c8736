"""SimHash near-duplicates against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from casebook.llm import simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, distance=3):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (lowest.get(r), d) if x is not None]
        lowest[r] = min(known) if known else None
    return sorted(((d, f"{p:016x}", lowest[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def corpus(rng, n=260):
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rows[rng.integers(len(rows))][1].split(" ")
            words[rng.integers(len(words))] = vocabulary[rng.integers(400)]
        else:
            words = [vocabulary[k] for k in rng.integers(0, 400, rng.integers(1, 120))]
        rows.append((int(i * 3 % n), " ".join(words)))
    return rows


@pytest.mark.parametrize("partitions,block_rows", [(None, 4096), (2, 16), (3, 4096), (4, 16), (5, 64)])
def test_same_components_as_brute_force(spark, partitions, block_rows):
    rows = corpus(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.simhash_components(docs, partitions=partitions, block_rows=block_rows)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One"), (5, "one  TWO"), (6, "ÄÖ two three"), (None, "one"), (None, "solo text"),
            (4, "One"), (7, long), (8, long + " end"), (9, "a b c"), (9, "d e f")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, id int, fp int")
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_large_ball_gives_few_links(spark):
    """Thousands of fingerprints within two bits of one: links, not pairs, come out."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    ball = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))}
    prints = np.array(sorted(ball), np.uint64).view(np.int64)
    classes = spark.createDataFrame([(int(p), i) for i, p in enumerate(prints)], "fp long, first long")
    groups = simhash.bit_groups(simhash.correlations(classes), 4)
    rows = simhash.probe_rows(classes, groups, simhash.counted_values(classes, groups), len(prints), 3)
    links = simhash.verified(rows, 3, 256).collect()
    assert len(links) < 40 * len(prints)
    reached, more = {int(prints[0])}, True
    while more:
        near = {x for r in links for x in (r["u"], r["v"]) if r["u"] in reached or r["v"] in reached}
        more = not near <= reached
        reached |= near
    assert reached == set(prints.tolist())


def test_thresholds_cost_least():
    rng = np.random.default_rng(2)
    cost = rng.random((4, 4, 50))
    cost[:, 0] = 0
    units = simhash.allocate(cost, 4)
    assert (units.sum(0) == 4).all()
    from itertools import product
    for q in range(50):
        least = min(sum(cost[i, u, q] for i, u in enumerate(c)) for c in product(range(4), repeat=4) if sum(c) == 4)
        assert np.isclose(sum(cost[i, units[i, q], q] for i in range(4)), least)


def test_estimates_count_neighbours():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, 1 << 16)
    near = simhash.near_counts(counts, 16, int(counts.sum()))
    from itertools import combinations
    for v in rng.integers(0, 1 << 16, 5).tolist():
        for radius in range(3):
            exact = sum(counts[v ^ sum(1 << b for b in c)] for r in range(radius + 1) for c in combinations(range(16), r))
            assert near[radius][v] == exact
