"""N-gram Jaccard join with a token-group matrix (operator 8).

1. Every text becomes its set of distinct word shingles (64-bit hashes).  Equal
   sets form a class, named by a fingerprint; from here on classes stand for their
   documents.  The same pass counts shingles in a sketch of fixed size over all
   documents, which gives one global order, rare shingles first.
2. A set's *prefix* is its first n - need + least shingles in that order, where
   need = ceil(threshold * n) and least = min(8, need): two sets that link share at
   least the smaller ``least`` of their prefix shingles, whatever the order is.
   Prefix shingles that only one class holds are dropped.
3. Similar classes are put into one group: a class joins the leader with which it
   shares the most prefix shingles, if they are half of ``least`` or more (with all of
   it, near copies that each share a few stay alone, and every pair of them meets on a
   common shingle).  Groups bound links from above, so any grouping is exact.  Large groups are dealt over several, so that
   no group is larger than ``group_size``.
4. The token-group matrix holds, per shingle, the groups whose prefix union has it.
   Joined with itself it bounds the prefix overlap of two groups from above; only
   groups whose bound reaches ``least`` are opened against each other.
5. An opened pair compares each member with the other group's full shingle union
   first, and the members that pass with each other, as products of 0/1 matrices.
   It returns a spanning forest of the links it found, not the pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.components import components
from casebook.llm.scratch import stored
from casebook.llm.words import mix, slices, split_words, window_hashes
from casebook.session import ship_package

SKETCH_BITS = 22
CHUNK = 1 << 12
LEAST = 8
GROUP_SIZE = 256
SMALL = 500_000  # rows of a few longs that may be broadcast
SEEN = 1_000_000
COLUMNS_AT_ONCE = 1 << 14


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle: each window of ``size`` words, or all words of
    a text with fewer; none for a text without words."""
    w = split_words(texts, lower=True)
    if not w.codes.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = w.hashes()[w.codes]
    found, text = window_hashes(hashes, w.counts, size)
    all_hashes, all_texts = [found], [text]
    first = w.bounds[:-1]
    for k in range(1, size):
        short = np.flatnonzero(w.counts == k)
        acc = np.full(short.size, k, np.uint64)
        for i in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[first[short] + i] + np.uint64(i + 1))
        all_hashes.append(acc)
        all_texts.append(short)
    return np.concatenate(all_hashes), np.concatenate(all_texts)


def distinct_sets(hashes: np.ndarray, text: np.ndarray, texts: int, level: np.ndarray | None = None):
    """Distinct shingles text by text, ordered by (level, hash): (hashes, bounds)."""
    keys = (hashes, text) if level is None else (hashes, level[bucket_of(hashes)], text)
    order = np.lexsort(keys)
    hashes, text = hashes[order], text[order]
    if hashes.size:
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))
        hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(texts + 1))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def class_names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, the same for equal sets; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0xA5A5)), dtype=np.uint64)])
    n = np.diff(bounds)
    names = mix(total[bounds[1:]] - total[bounds[:-1]] + mix(n.astype(np.uint64)))
    return np.where(n == 0, np.uint64(0), names | np.uint64(1)).view(np.int64)


def need(n, percent: int):
    return -(-percent * n // 100)


def least(n, percent: int):
    return np.minimum(LEAST, need(n, percent))


def least_column(n: Column, percent: int) -> Column:
    return F.least(F.lit(LEAST), F.ceil(n * F.lit(percent) / F.lit(100)))


def profile(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, cid) of every row, and the sketch pieces (part, counts) of each task."""
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in slices(batches, "text"):
            hashes, bounds = distinct_sets(*shingles(b.column("text"), size), b.num_rows)
            sketch += np.bincount(bucket_of(hashes), minlength=len(sketch)).astype(np.uint32)
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(class_names(hashes, bounds)), none,
                 pa.nulls(b.num_rows, pa.binary())], names=["id", "n", "cid", "part", "counts"])
        parts = sketch.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        if used.size:
            none = pa.nulls(used.size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(used.size, id_type[0]), none, none, pa.array(used, pa.int32()),
                 pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())],
                names=["id", "n", "cid", "part", "counts"])

    kind = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = [to_arrow_type(kind)]
    return docs.mapInArrow(run, f"id {kind.simpleString()}, n long, cid long, part int, counts binary")


def levels(profiles: DataFrame) -> np.ndarray:
    """log2 of the summed sketch: a byte for each of its 2^SKETCH_BITS counters."""
    def add(key, table):
        total = np.zeros(CHUNK, np.int64)
        for v in table["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(v), np.uint32)
        level = np.log2(total + 1).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(((1 << SKETCH_BITS) // CHUNK, CHUNK), np.uint8)
    rows = (profiles.where("part IS NOT NULL").select("part", "counts").groupBy("part")
            .applyInArrow(add, "part int, level binary").collect())
    for r in rows:
        out[r["part"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, cid, n) for the prefix of every set; copies met in one task once."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches, "text"):
            hashes, bounds = distinct_sets(*shingles(b.column("text"), size), b.num_rows, shared.value)
            n = np.diff(bounds)
            # The name sums over the set, so its order does not matter.
            names = class_names(hashes, bounds)
            take = n - need(n, percent) + least(n, percent)
            for i, name in enumerate(names.tolist()):
                if name in seen:
                    take[i] = 0
                seen.add(name)
            if len(seen) > SEEN:
                seen.clear()
            take[n == 0] = 0
            rank = np.arange(hashes.size) - np.repeat(bounds[:-1], n)
            chosen = rank < np.repeat(take, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[chosen].view(np.int64)), pa.array(np.repeat(names, take)),
                 pa.array(np.repeat(n, take).astype(np.int32))], names=["token", "cid", "n"])

    return docs.select("text").mapInArrow(run, "token long, cid long, n int")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(token, cid, n, leader) of the tokens that several classes hold; the leader is
    the smallest class.  The rows of a token arrive sorted and are streamed, so a
    common token needs no memory."""
    def run(batches):
        # Head of the open token: its first row, the last class seen, whether it went out.
        head, last, out = None, None, False
        for b in batches:
            t, c, n = (b.column(x).to_numpy() for x in ("token", "cid", "n"))
            if not t.size:
                continue
            again = np.append(head is not None and t[0] == head[0] and c[0] == last,
                              (t[1:] == t[:-1]) & (c[1:] == c[:-1]))
            t, c, n = t[~again], c[~again], n[~again]
            if not t.size:
                continue
            held = head is not None and t[0] == head[0]
            if head is not None and (not held or not out):
                # put the waiting first row back in front
                if not out:
                    t, c, n = (np.concatenate([[v], x]) for v, x in zip(head, (t, c, n)))
                    held = False
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = np.diff(np.append(starts, t.size))
            leader = np.repeat(c[starts], size)
            many = np.repeat(size >= 2, size)
            if held:
                leader[:size[0]] = head[1]
                many[:size[0]] = True
            tail = starts[-1]
            if not (held and len(starts) == 1):
                head = (t[tail], c[tail], n[tail])
                out = bool(size[-1] >= 2)
            last = c[-1]
            yield pa.RecordBatch.from_arrays([pa.array(t[many]), pa.array(c[many]), pa.array(n[many].astype(np.int32)),
                                              pa.array(leader[many])], names=["token", "cid", "n", "leader"])

    return (tokens.repartition(F.col("token")).sortWithinPartitions("token", "cid")
            .mapInArrow(run, "token long, cid long, n int, leader long"))


def grouped(shared: DataFrame, percent: int, group_size: int) -> DataFrame:
    """(cid, n, gid): the group of every class that shares a prefix token."""
    ties = (shared.where("cid <> leader").groupBy("cid", "leader", "n").agg(F.count(F.lit(1)).alias("c"))
            .where(F.col("c") * 2 >= least_column(F.col("n"), percent))
            .groupBy("cid").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("label")))
    classes = shared.groupBy("cid").agg(F.first("n").alias("n")).join(ties, "cid", "left")
    classes = stored(classes.select("cid", "n", F.coalesce("label", "cid").alias("label")), "jac-labels")
    crowds = classes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group_size)
    # At most (number of classes / group_size) rows; joined, not broadcast by hand.
    dealt = classes.join(crowds, "label", "left")
    part = F.when(F.col("m").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / group_size).cast("long")))
    return stored(dealt.select("cid", "n", F.xxhash64("label", part).alias("gid")), "jac-groups")


def candidate_pairs(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(ga, gb), ga <= gb: the groups that must be opened against each other."""
    matrix = stored(shared.join(groups.select("cid", "gid"), "cid").groupBy("token", "gid")
                    .agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "jac-matrix")
    a = matrix.select("token", F.col("gid").alias("ga"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = matrix.select("token", F.col("gid").alias("gb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    p = F.lit(percent)
    # Sets that link have sizes within the threshold of each other, so this holds on
    # every token that they share.
    fit = (F.col("ahi") * 100 >= F.col("blo") * p) & (F.col("bhi") * 100 >= F.col("alo") * p)
    b = b.withColumnRenamed("token", "_token")
    met = (a.join(b, (F.col("token") == F.col("_token")) & (F.col("ga") < F.col("gb")) & fit).groupBy("ga", "gb")
           .agg(F.count(F.lit(1)).alias("c"), F.min("alo").alias("alo"), F.min("blo").alias("blo")))
    met = met.where(F.col("c") >= F.least(least_column(F.col("alo"), percent), least_column(F.col("blo"), percent)))
    own = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    return met.select("ga", "gb").union(own)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of ``left`` with all of ``right``."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def matrix(sets, words):
        m = np.zeros((len(sets), len(words)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(words, s), len(words) - 1)
            m[i, at[words[at] == s]] = 1
        return m

    for i in range(0, len(vocabulary), COLUMNS_AT_ONCE):
        words = vocabulary[i:i + COLUMNS_AT_ONCE]
        out += matrix(left, words) @ matrix(right, words).T
    return out


def open_groups(cids: list[int], sets: list[np.ndarray], in_a: np.ndarray, in_b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the members of two groups (or inside one), as (class, smaller
    class) pairs that span the components they form."""
    a, b = np.flatnonzero(in_a), np.flatnonzero(in_b)
    for _ in range(2):  # bound each side by the other side's union of shingles
        if not a.size or not b.size:
            return []
        union = np.unique(np.concatenate([sets[i] for i in b]))
        reach = np.array([np.isin(sets[i], union, assume_unique=True).sum() for i in a])
        sizes = np.array([len(sets[i]) for i in a])
        a, b = b, a[100 * reach >= percent * sizes]
    if not a.size or not b.size:
        return []
    size = np.array([len(s) for s in sets])
    common = overlaps([sets[i] for i in a], [sets[i] for i in b])
    together = size[a][:, None] + size[b][None, :] - common
    x, y = np.nonzero(100 * common >= percent * together)
    x, y = a[x], b[y]
    apart = x != y
    x, y = x[apart], y[apart]
    names = np.array(cids)
    root = names.copy()
    while x.size:  # smallest name spreads along the links
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        if (before == root).all():
            break
    return [(int(n), int(r)) for n, r in zip(names, root) if n != r]


def links(docs: DataFrame, profiles: DataFrame, groups: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) edges between classes that span all links."""
    used = pairs.select(F.explode(F.array("ga", "gb")).alias("gid")).distinct()
    first = profiles.where("part IS NULL AND n > 0").groupBy("cid").agg(F.min("id").alias("id"))
    wanted = stored(groups.join(used, "gid", "left_semi").join(first, "cid").select("id", "cid", "gid"), "jac-wanted")
    near = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    texts = docs.join(near.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).select("text", "cid", "gid")

    def read(batches):
        for b in slices(batches, "text"):
            hashes, bounds = distinct_sets(*shingles(b.column("text"), size), b.num_rows)
            same = class_names(hashes, bounds) == b.column("cid").to_numpy()
            keep = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [b.column("cid").take(pa.array(keep)), b.column("gid").take(pa.array(keep)),
                 pa.array([hashes[bounds[i]:bounds[i + 1]].tobytes() for i in keep], pa.binary())], names=["cid", "gid", "shingles"])

    sets = stored(texts.mapInArrow(read, "cid long, gid long, shingles binary"), "jac-sets")
    sides = pairs.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("gid"))
    opened = (sides.join(sets, "gid").repartition(F.col("ga"), F.col("gb")).sortWithinPartitions("ga", "gb"))

    def compare(batches):
        pair, members = None, {}

        def finish():
            cids = list(members)
            found = open_groups(cids, [members[c][0] for c in cids], np.array([pair[0] in members[c][1] for c in cids]),
                                np.array([pair[1] in members[c][1] for c in cids]), percent)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())],
                                              names=["u", "v"])

        for b in batches:
            for ga, gb, gid, cid, raw in zip(*(b.column(c).to_pylist() for c in ("ga", "gb", "gid", "cid", "shingles"))):
                if (ga, gb) != pair:
                    if len(members) > 1:
                        yield finish()
                    pair, members = (ga, gb), {}
                members.setdefault(cid, (np.frombuffer(raw, np.uint64), set()))[1].add(gid)
        if len(members) > 1:
            yield finish()

    return opened.select("ga", "gb", "gid", "cid", "shingles").mapInArrow(compare, "u long, v long")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text",
                       group_size: int = GROUP_SIZE) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Words are lower-cased (A-Z); two rows link when 100 * |A and B| >= percent *
    |A or B| over their sets of ``size``-word shingles; component_id is the smallest
    key reachable.  A text with fewer words is one shingle; without words (or null)
    the set is empty and links with nothing, so component_id is the row's own key.
    A null key is larger than any other: it is the component's only if all are null.
    Rows with equal keys are one node of their component each.  Other columns are
    left behind.  Empty table: no rows.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    profiles = stored(profile(docs, size), "jac-profiles")
    level = levels(profiles)
    shared = stored(shared_tokens(prefixes(docs, level, size, percent)), "jac-shared")
    groups = grouped(shared, percent, group_size)
    pairs = stored(candidate_pairs(shared, groups, percent), "jac-pairs")
    edges = stored(links(docs, profiles, groups, pairs, size, percent), "jac-links")
    roots = components(edges)
    rows = profiles.where("part IS NULL")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("first"))
    named = stored(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                   .select("cid", "first", F.coalesce("root", "cid").alias("root")), "jac-named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(named.join(lowest, "root").select("cid", "component"), "jac-components")
    return (rows.join(named, "cid", "left")
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id")))
