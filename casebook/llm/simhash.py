"""SimHash near-duplicates by a generalised pigeonhole search (operator 11).

1. A document's fingerprint has a bit set where more than half of its shingle hashes
   have it.  Equal fingerprints form a class; only classes are searched.
2. Bits that vary together, by a 64 x 64 table of counts over all classes, are put into
   the same of m partitions.  If two fingerprints differ in at most ``distance`` bits
   and thresholds t_1 .. t_m sum to distance - m + 1, they differ by at most t_i in some
   partition i (t_i = -1 skips the partition).
3. Every class as a query takes the thresholds of least estimated cost, by dynamic
   programming over its partitions; the estimate comes from counters of fixed size over
   the partition values of all classes.  So common values are probed narrowly or not at
   all, and rare ones more widely.
4. Index rows (partition, value) and probes meet in groups.  Values that many classes
   hold are dealt over blocks of bounded size.  A task verifies a block with 64-bit
   arithmetic and returns links that span what it found, not the pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.components import components
from casebook.llm.scratch import stored
from casebook.llm.words import IS_WORD, slices, split_words
from casebook.session import ship_package

SEED = 42
COUNTER_BITS = 16
WIDEST = 2        # largest threshold of one partition
PROBE_COST = 64   # a probe costs as much as verifying so many candidates
BLOCK_ROWS = 4096
FEW = 64          # index rows up to which a group's pairs are verified one by one
PAIRS_AT_ONCE = 1 << 21
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, text) of every window of ``size`` words joined by single spaces, repeats
    included; all words of a text with fewer."""
    w = split_words(texts, lower=True)
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    long = w.ends - w.starts
    letters = w.raw[IS_WORD[w.raw]]
    joined = np.full(letters.size + n, 0x20, np.uint8)
    joined[np.arange(letters.size) + np.repeat(np.arange(n), long)] = letters
    start = np.cumsum(long + 1) - long - 1
    end, text = start + long, w.text_of_word()
    last = np.minimum(np.arange(n) + size - 1, w.bounds[1:][text] - 1)
    # A window begins at every word with enough after it, and at a short text's first.
    whole = np.arange(n) + size <= w.bounds[1:][text]
    first = np.arange(n) == w.bounds[:-1][text]
    begin = np.flatnonzero(whole | (first & (w.counts[text] < size)))
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(start[begin].tolist(), end[last[begin]].tolist())
    return np.fromiter((digest(data[a:z], SEED) for a, z in spans), np.uint64, len(begin)), text[begin]


def majority(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The fingerprint of every text; 0 without shingles."""
    total = np.bincount(text, minlength=texts)
    out = np.zeros(texts, np.uint64)
    for place in range(8):
        byte = ((hashes >> np.uint64(8 * place)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(text * 256 + byte, minlength=texts * 256).reshape(texts, 256).astype(np.float64)
        most = 2 * (seen @ BITS.astype(np.float64)) > total[:, None]
        out |= (most @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * place)
    return out


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(id, fp) of every row."""
    def run(batches):
        for b in slices(batches, "text"):
            hashes, text = shingle_hashes(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(majority(hashes, text, b.num_rows).view(np.int64))],
                                             names=["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def correlations(classes: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all classes (64 x 64)."""
    def count(batches):
        total = np.zeros((64, 64))
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 1 << 14):
                bits = ((fp[i:i + (1 << 14), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    n = classes.count()
    both = np.zeros(4096)
    for r in classes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[r["at"]] = r["n"]
    both = both.reshape(64, 64)
    ones = np.diag(both)
    spread = np.sqrt(np.outer(ones * (n - ones), ones * (n - ones)))
    out = np.abs(np.divide(n * both - np.outer(ones, ones), spread, out=np.zeros((64, 64)), where=spread > 0))
    np.fill_diagonal(out, 0)
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def partitions_for(n: int, distance: int) -> int:
    """The number of partitions of least cost for ``n`` evenly spread fingerprints."""
    def cost(m: int) -> float:
        units = distance + 1
        total = 0.0
        for i in range(m):
            radius = units // m + (i < units % m) - 1
            width = 64 // m + (i < 64 % m)
            total += ball(width, radius) * (PROBE_COST + n / 2.0 ** width) if radius <= WIDEST else math.inf
        return total

    return min(range(1, min(distance + 1, 64) + 1), key=cost)


def bit_groups(related: np.ndarray, m: int) -> list[list[int]]:
    """Greedy partition of the bits: the free bit most related to the open group joins."""
    free, out = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        left = sorted(free)
        group = [left[int(np.argmax(related[np.ix_(left, left)].sum(1)))]]
        free.discard(group[0])
        while len(group) < width:
            left = sorted(free)
            group.append(left[int(np.argmax(related[np.ix_(left, group)].sum(1)))])
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def values_of(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints' bits of one partition, as a number."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def counter_of(value: np.ndarray) -> np.ndarray:
    """The counter of a value: its 16-bit pieces, folded (a changed bit changes one bit)."""
    out = np.zeros(len(value), np.uint64)
    for shift in range(0, 64, COUNTER_BITS):
        out ^= (value >> np.uint64(shift)) & np.uint64((1 << COUNTER_BITS) - 1)
    return out.astype(np.int64)


def near_counts(counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """(WIDEST + 1, counters): estimated classes within each radius of a value."""
    if width > COUNTER_BITS:  # several values share a counter: take the even share off
        counts = np.maximum(counts - n / 2.0 ** COUNTER_BITS, 0) + n / 2.0 ** width
    at = np.arange(len(counts))
    flips = [1 << (b % COUNTER_BITS) for b in range(width)]
    step = lambda x: sum(x[at ^ f] for f in flips)
    out, rings = [counts.astype(np.float64)], [counts.astype(np.float64)]
    for radius in range(1, WIDEST + 1):
        # Values reached by one more flip, each counted once per order of its flips.
        further = step(rings[-1]) - (rings[-2] * (width - radius + 2) if radius > 1 else 0)
        rings.append(np.maximum(further / radius, 0))
        out.append(out[-1] + rings[-1])
    return np.array(out)


def allocate(cost: np.ndarray, units: int) -> np.ndarray:
    """Thresholds + 1 of least total cost: ``cost[i, u, q]`` is what ``u`` units cost query
    q in partition i; the units of a query sum to ``units``."""
    m, choices, q = cost.shape
    total = np.full((units + 1, q), math.inf)
    total[0] = 0
    taken = np.zeros((m, units + 1, q), np.int8)
    for i in range(m):
        now = np.full((units + 1, q), math.inf)
        for spent in range(units + 1):
            for u in range(min(choices - 1, spent) + 1):
                this = total[spent - u] + cost[i, u]
                better = this < now[spent]
                now[spent][better] = this[better]
                taken[i, spent][better] = u
        total = now
    out, left = np.zeros((m, q), np.int64), np.full(q, units)
    for i in range(m - 1, -1, -1):
        out[i] = taken[i, left, np.arange(q)]
        left = left - out[i]
    return out


def probe_rows(classes: DataFrame, groups: list[list[int]], counters: np.ndarray, n: int, distance: int) -> DataFrame:
    """(part, value, kind, fp): kind 0 for the index, 1 for the probes of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(counters)

    def run(batches):
        table = [near_counts(shared.value[i], len(g), n) for i, g in enumerate(groups)]
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            values = [values_of(fp, g) for g in groups]
            cost = np.zeros((len(groups), WIDEST + 2, len(fp)))
            for i, g in enumerate(groups):
                at = counter_of(values[i])
                for radius in range(WIDEST + 1):
                    cost[i, radius + 1] = table[i][radius][at] + PROBE_COST * ball(len(g), radius)
            units = allocate(cost, distance + 1)
            for i, g in enumerate(groups):
                yield rows(i, values[i], 0, fp)
                for radius in range(WIDEST + 1):
                    asks = np.flatnonzero(units[i] > radius)
                    if not asks.size:
                        continue
                    for flips in combinations(range(len(g)), radius):
                        mask = np.uint64(sum(1 << f for f in flips))
                        yield rows(i, values[i][asks] ^ mask, 1, fp[asks])

    def rows(part: int, value: np.ndarray, kind: int, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)),
                                           pa.array(np.full(len(fp), kind, np.int32)), pa.array(fp.view(np.int64))],
                                          names=["part", "value", "kind", "fp"])

    return classes.select("fp").mapInArrow(run, "part int, value long, kind int, fp long")


def counted_values(classes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many classes fall on each counter of each partition."""
    def run(batches):
        total = np.zeros((len(groups), 1 << COUNTER_BITS), np.int64)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                total[i] += np.bincount(counter_of(values_of(fp, g)), minlength=1 << COUNTER_BITS)
        part, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(at), pa.array(total[part, at])], names=["part", "at", "n"])

    out = np.zeros((len(groups), 1 << COUNTER_BITS), np.int64)
    sums = classes.select("fp").mapInArrow(run, "part int, at long, n long").groupBy("part", "at").agg(F.sum("n").alias("n")).toArrow()
    out[sums["part"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    return out


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected with it) of the nodes that have a smaller one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def span(index: np.ndarray, asked: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what the links between ``asked`` and ``index`` connect."""
    us, vs = [], []
    names = index.copy()  # smallest fingerprint known to be connected
    step = max(1, PAIRS_AT_ONCE // len(index))
    for i in range(0, len(asked), step):
        q = asked[i:i + step]
        near = np.bitwise_count(q[:, None] ^ index[None, :]) <= distance
        own = q.copy()
        while True:
            low = np.minimum(own, np.where(near, names[None, :], np.iinfo(np.uint64).max).min(1))
            back = np.minimum(names, np.where(near, low[:, None], np.iinfo(np.uint64).max).min(0))
            if (low == own).all() and (back == names).all():
                break
            for nodes, before, now in ((q, own, low), (index, names, back)):
                moved = now < before
                # The node and what it was joined to before both follow.
                us += [nodes[moved], before[moved]]
                vs += [now[moved], now[moved]]
            own, names = low, back
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(us), np.concatenate(vs))


def verified(rows: DataFrame, distance: int, block_rows: int) -> DataFrame:
    """(u, v) links between fingerprints."""
    key = ["part", "value"]
    crowds = (rows.where("kind = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block_rows)
              .select(*key, F.ceil(F.col("held") / block_rows).cast("int").alias("blocks")))
    dealt = rows.join(crowds, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
                                                .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))

    def run(batches):
        held = None  # index rows of the group that the last batch ended in
        for b in batches:
            part, value, block, kind, fp = (b.column(c).to_numpy() for c in ("part", "value", "block", "kind", "fp"))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            if held is not None and held[0] == (part[0], value[0], block[0]):
                (p, v, k), kept = held
                part, value, block = (np.concatenate([np.full(len(kept), x, y.dtype), y]) for x, y in ((p, part), (v, value), (k, block)))
                kind, fp = np.concatenate([np.zeros(len(kept), kind.dtype), kind]), np.concatenate([kept, fp])
            new = np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1]))
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            size = np.bincount(group[kind == 0], minlength=len(start))
            held = ((part[-1], value[-1], block[-1]), fp[start[-1]:start[-1] + size[-1]].copy())
            asks = np.flatnonzero(kind == 1)
            small = asks[(size[group[asks]] > 0) & (size[group[asks]] <= FEW)]
            for i in range(0, len(small), PAIRS_AT_ONCE // FEW):
                q = small[i:i + PAIRS_AT_ONCE // FEW]
                times = size[group[q]]
                other = np.arange(times.sum()) + np.repeat(start[group[q]] - (np.cumsum(times) - times), times)
                u, v = np.repeat(fp[q], times), fp[other]
                near = (np.bitwise_count(u ^ v) <= distance) & (u != v)
                yield links(*forest(u[near], v[near]))
            for g in np.unique(group[asks[size[group[asks]] > FEW]]).tolist():
                yield links(*span(fp[start[g]:start[g] + size[g]], fp[asks[group[asks] == g]], distance))

    def links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return (dealt.select(*key, "block", "kind", "fp").repartition(*key, "block").sortWithinPartitions(*key, "block", "kind")
            .mapInArrow(run, "u long, v long"))


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text",
                       partitions: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Words are lower-cased (A-Z); a fingerprint bit is set if more than half of the
    ``size``-word shingles' XXH64 (seed 42), repeats included, have it.  A text with fewer
    words is one shingle; without words (or null) the fingerprint is zero.  Fingerprints
    link at ``distance`` or fewer differing bits; component_id is the smallest key
    reachable.  A null key is larger than any other.  Repeated rows each get a row.
    Other columns are left behind.  Empty table: no rows.  ``partitions`` is chosen by cost
    unless given; results do not depend on it.
    """
    ship_package(docs.sparkSession)
    if not 0 <= distance < 64:
        raise ValueError("distance must be from 0 to 63")
    if partitions is not None and not distance < partitions * (WIDEST + 1) <= 64 * (WIDEST + 1):
        raise ValueError("too few or too many partitions")
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = stored(fingerprints(docs, size), "sim-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "sim-classes")
    n = classes.count()
    m = partitions or partitions_for(n, distance)
    groups = bit_groups(correlations(classes), m)
    rows = stored(probe_rows(classes, groups, counted_values(classes, groups), n, distance), "sim-probes")
    roots = components(stored(verified(rows, distance, block_rows), "sim-links"))
    named = stored(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "first", F.coalesce("root", "fp").alias("root")), "sim-named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(named.join(lowest, "root").select("fp", "component"), "sim-components")
    return prints.join(named, "fp").select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                           F.col("component").alias("component_id"))
