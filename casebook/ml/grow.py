"""Random forests grown on every row of a fit that is too large for Spark ML's trainer (M3 M6).

Spark ML sends the statistics of all bins of all nodes from every partition, also of nodes
with a handful of rows: deep trees cost far more than their rows.  Here the features are
binned once (rows alike in all bins and the label become one row with their number), and
only nodes of more than ``GROUP_ROWS`` rows are split by statistics that tasks send.  The
rows of a smaller node are brought together and one task grows it to its end.  Both find
splits by ``best_splits``, with Spark ML's rules: bootstrap by Poisson weights, categories
ordered by their mean label, ``minInstancesPerNode``, gains above zero, features tried at random.

The result is a table in the layout of Spark ML's saved trees (ids in preorder).  The driver
holds only the nodes above the groups.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import ship_package, stored

GROUP_ROWS = 1 << 20   # binned rows of a node, at most, that one task grows to its end
BLOCK_ROWS = 1 << 16   # binned rows that a task works on at once
FILE_ROWS = 1 << 20    # about the rows of a partition of the binned table, where there are many
LEVEL_CELLS = 1 << 23  # bins (of all nodes and features) whose statistics a task sends, at most
NODE_CELLS = 1 << 19   # bins (of all nodes) that a task compares at once within a group
GROUPS_ROWS = 1 << 22  # about the rows of a partition of groups, at most


@dataclass(frozen=True)
class Rules:
    """What splits are made of; ``arity``: the labels of a feature split by sets, -1 for an ordered one."""
    cuts: list     # thresholds of the ordered features
    arity: list
    tried: int     # features compared at a node
    depth: int
    least: int     # drawn rows on either side of a split
    seed: int
    classes: bool  # labels 0 and 1 (Gini impurity), else numbers (variance)

    @property
    def bins(self) -> list[int]:
        return [a if a >= 0 else len(c) + 1 for a, c in zip(self.arity, self.cuts)]


def thresholds(df: DataFrame, col: str, max_bins: int) -> list[float]:
    """The middles between the values of ``col``, or if there are more than ``max_bins`` values
    about equal shares of all rows."""
    few = [r[0] for r in df.select(col).distinct().limit(max_bins + 1).collect()]
    if len(few) <= max_bins:
        few.sort()
        return [(a + b) / 2 for a, b in zip(few, few[1:])]
    at = F.percentile_approx(col, [i / max_bins for i in range(1, max_bins)], 10_000)
    return sorted(set(df.select(at).first()[0]))


def binned(df: DataFrame, cols: list[str], rules: Rules, parts: int) -> DataFrame:
    """The bins ``_b0``.. of the rows and their label, with ``_n``, the number of rows alike, and
    ``_id``; computed once, into the shared folder."""
    cut = [j for j, c in enumerate(rules.cuts) if c]
    if cut:
        # The bucketizer's intervals are closed on the left, a tree's on the right.
        df = Bucketizer(inputCols=[cols[j] for j in cut], outputCols=[f"_b{j}" for j in cut], splitsArray=[
            [-np.inf, *np.nextafter(rules.cuts[j], np.inf).tolist(), np.inf] for j in cut]).transform(df)
    bins = [F.col(f"_b{j}") if j in cut else F.col(c) if a >= 0 else F.lit(0) for j, (c, a) in enumerate(zip(cols, rules.arity))]
    names = [f"_b{j}" for j in range(len(cols))]
    rows = df.select(*[b.cast("short").alias(x) for b, x in zip(bins, names)], "label").groupBy(*names, "label").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return stored(rows.repartition(parts).withColumn("_id", F.monotonically_increasing_id()), "binned")


# ------------------------------------------------------------------ the sample of a tree

def _draws() -> np.ndarray:
    """Row n: the values that a Poisson variable of mean n takes at 65,536 even steps."""
    at, table = (np.arange(1 << 16) + 0.5) / (1 << 16), []
    for n in range(33):
        p = np.exp(-n) * np.cumprod(np.concatenate([[1.0], n / np.arange(1.0, 128.0)]))
        table.append(np.searchsorted(np.cumsum(p), at))
    return np.array(table, np.uint8)


DRAWS = _draws()


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each binned row is in the bootstrap sample of ``tree``: a Poisson variable of
    mean ``n`` that depends on the row's id alone, so it is the same in every pass."""
    key = _mixed(np.array([tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFF))
    h, low = _mixed(ids.astype(np.uint64) + key), np.uint64(0xFFFF)
    out = DRAWS[n % 32, h & low].astype(np.int64)
    many = np.flatnonzero(n >= 32)
    for k in range(1, int(n.max(initial=0)) // 32 + 1):
        many = many[n[many] >= 32 * k]
        out[many] += DRAWS[32, _mixed(h[many] + np.uint64(k)) & low]
    return out


# ------------------------------------------------------------------ splits

def histograms(codes: np.ndarray, node: np.ndarray, k: int, w: np.ndarray, wy: np.ndarray, bins) -> list:
    """By feature: the drawn rows and their label sums per node and bin."""
    out = []
    for j, b in enumerate(bins):
        at = node * b + codes[:, j]
        out.append([np.bincount(at, x, k * b).reshape(k, b) for x in (w, wy)])
    return out


def best_splits(sums: list, square: np.ndarray, rules: Rules, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: the feature of its best split (-1: none), the bins that go left, and what the
    split takes off the sum of squared errors.  ``square``: the sums of squared labels."""
    k, m = len(square), len(rules.bins)
    weight, total = sums[0][0].sum(1), sums[0][1].sum(1)
    tried = np.ones((k, m), bool)
    if rules.tried < m:
        tried = rng.random((k, m)).argsort(axis=1).argsort(axis=1) < rules.tried
    none = total * total / np.maximum(weight, 1)
    # A gain that rounding alone can make is none.
    gain, feature, cut, orders = 1e-12 * square, np.full(k, -1), np.zeros(k, np.int64), {}
    for j, (w, s) in enumerate(sums):
        if w.shape[1] < 2:
            continue
        if rules.arity[j] >= 0:
            orders[j] = np.where(w > 0, s / np.maximum(w, 1), np.inf).argsort(axis=1, kind="stable")
            w, s = np.take_along_axis(w, orders[j], 1), np.take_along_axis(s, orders[j], 1)
        w, s = np.cumsum(w, 1)[:, :-1], np.cumsum(s, 1)[:, :-1]
        rest, other = weight[:, None] - w, total[:, None] - s
        score = s * s / np.maximum(w, 1) + other * other / np.maximum(rest, 1)
        score[(w < rules.least) | (rest < rules.least) | ~tried[:, j, None]] = -np.inf
        at = score.argmax(1)
        mine = score[np.arange(k), at] - none
        better = mine > gain
        gain, feature, cut = np.where(better, mine, gain), np.where(better, j, feature), np.where(better, at, cut)
    left = np.zeros((k, max(rules.bins)), bool)
    for j, b in enumerate(rules.bins):
        here = np.flatnonzero(feature == j)
        rank = orders[j][here].argsort(axis=1) if j in orders else np.arange(b)[None, :]
        left[here, :b] = rank <= cut[here, None]
    return feature, left, gain


def grown(codes: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, rules: Rules, tree: int) -> list:
    """All nodes below and with ``root`` (numbered 1 at the top, 2i and 2i + 1 below i), level by
    level: ids, features, bins that go left, gains, and the sums of weights, labels and their squares."""
    node, ids, level, out = np.zeros(len(y), np.int64), np.array([root]), root.bit_length() - 1, []
    w = w.astype(float)
    wy = w * y
    step = max(1, NODE_CELLS // sum(rules.bins))
    while True:
        k = len(ids)
        totals = [np.bincount(node, x, k) for x in (w, wy, wy * y)]
        found = []
        for low in range(0, k if level < rules.depth else 0, step):
            size = min(step, k - low)
            some = slice(None) if size == k else np.flatnonzero((node >= low) & (node < low + size))
            sums = histograms(codes[some], node[some] - low, size, w[some], wy[some], rules.bins)
            found.append(best_splits(sums, totals[2][low:low + size], rules, np.random.default_rng([rules.seed & 0xFFFFFFFF, tree, root, level, low])))
        if found:
            feature, left, gain = (np.concatenate(x) for x in zip(*found))
        else:
            feature, left, gain = np.full(k, -1), np.zeros((k, max(rules.bins)), bool), np.zeros(k)
        out.append((ids, feature, left, gain, *totals))
        split = feature >= 0
        if not split.any():
            return out
        kept = np.flatnonzero(split[node])
        codes, node, w, wy, y = codes[kept], node[kept], w[kept], wy[kept], y[kept]
        goes_left = left[node, codes[np.arange(len(node)), feature[node]]]
        node = 2 * (np.cumsum(split) - 1)[node] + ~goes_left
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
        level += 1


# ------------------------------------------------------------------ passes over the rows

@dataclass
class Top:
    """The nodes of a tree that are above its groups; ``slot`` numbers those that a pass asks for."""
    ids: list
    feature: list
    left: list
    kids: list
    totals: list  # (weight, labels, squares, gain) of a split node or leaf

    @classmethod
    def new(cls, bins: int) -> Top:
        return cls([1], [0], [np.zeros(bins, bool)], [[0, 0]], [None])

    def split(self, at: int, feature: int, left: np.ndarray, totals: tuple) -> list[int]:
        new = [len(self.ids), len(self.ids) + 1]
        self.feature[at], self.left[at], self.kids[at], self.totals[at] = feature, left, new, totals
        for i, a in enumerate(new):
            self.ids.append(2 * self.ids[at] + i)
            self.feature.append(0)
            self.left.append(np.zeros(len(left), bool))
            self.kids.append([a, a])
            self.totals.append(None)
        return new

    def asked(self, nodes: list[int]) -> tuple:
        """What a task needs to walk and count: arrays and the slots of ``nodes``."""
        slot = np.full(len(self.ids), -1)
        slot[nodes] = np.arange(len(nodes))
        depth = max(self.ids).bit_length() - 1
        return (np.array(self.feature), np.array(self.left), np.array(self.kids).ravel(), slot, depth, [self.ids[a] for a in nodes])


def _blocks(batches, bins):
    """Codes, labels, numbers of rows alike and ids of about ``BLOCK_ROWS`` rows at a time."""
    held, size = [], 0

    def arrays():
        t = pa.Table.from_batches(held)
        kind = np.uint8 if max(bins) <= 256 else np.uint16
        codes = np.stack([t[f"_b{j}"].to_numpy().astype(kind) for j in range(len(bins))], axis=1)
        return codes, t["label"].to_numpy(), t["_n"].to_numpy(), t["_id"].to_numpy()

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BLOCK_ROWS:
            yield arrays()
            held, size = [], 0
    if size:
        yield arrays()


def _met(block, asked: dict, rules: Rules):
    """Of every asked tree: the drawn rows of the block that lie in an asked node, their slots and weights."""
    codes, _, n, ids = block
    flat, m = codes.ravel(), codes.shape[1]
    for tree, (feature, left, kids, slot, depth, _) in asked.items():
        w = drawn(ids, n, tree, rules.seed)
        rows = np.flatnonzero(w)
        node = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            node = kids[2 * node + ~left[node, flat[rows * m + feature[node]]]]
        at = slot[node]
        here = np.flatnonzero(at >= 0)
        rows = rows[here]
        yield tree, rows, at[here], w[rows]


def _statistics(asked: dict, rules: Rules):
    """A task's statistics of the asked nodes, a row per tree: per feature, node and bin the
    weights and label sums; per node the squares and the number of binned rows."""
    def run(batches):
        held = {}
        for block in _blocks(batches, rules.bins):
            codes, y = block[:2]
            for tree, rows, at, w in _met(block, asked.value, rules):
                k, w = len(asked.value[tree][5]), w.astype(float)
                wy = w * y[rows]
                sums = histograms(codes[rows], at, k, w, wy, rules.bins)
                new = np.concatenate([*(x.ravel() for pair in sums for x in pair), np.bincount(at, wy * y[rows], k), np.bincount(at, minlength=k)])
                held[tree] = held[tree] + new if tree in held else new
        for tree, x in held.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "sums": [x.tobytes()]})
    return run


def _decide(asked: dict, rules: Rules, level: int):
    """The best splits of a tree's asked nodes, from the statistics of all tasks."""
    def run(key, table):
        tree = key[0].as_py()
        x = sum(np.frombuffer(b.as_py()) for b in table["sums"])
        k, sums, at = len(asked.value[tree][5]), [], 0
        for b in rules.bins:
            sums.append([x[at + i * k * b:at + (i + 1) * k * b].reshape(k, b) for i in range(2)])
            at += 2 * k * b
        square, rows = x[at:at + k], x[at + k:]
        rng = np.random.default_rng([rules.seed & 0xFFFFFFFF, tree, 0, level, asked.value[tree][5][0]])
        feature, left, gain = best_splits(sums, square, rules, rng)
        if level >= rules.depth:
            feature[:] = -1
        said = pickle.dumps((feature, left, gain, sums[0][0].sum(1), sums[0][1].sum(1), square, rows))
        return pa.table({"tree": pa.array([tree], pa.int32()), "said": [said]})
    return run


def _handed(asked: dict, rules: Rules, kind: list):
    """The drawn rows of the asked nodes, packed, a row per node and block."""
    def run(batches):
        for block in _blocks(batches, rules.bins):
            codes, y, _, ids = block
            for tree, rows, at, w in _met(block, asked.value, rules):
                if not len(rows):
                    continue
                order = np.argsort(at, kind="stable")
                packed = np.empty(len(rows), kind)
                packed["c"], packed["y"], packed["w"] = codes[rows[order]], y[rows[order]], w[order]
                found, first = np.unique(at[order], return_index=True)
                ends = [*first[1:].tolist(), len(rows)]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(found), pa.int32()), "node": pa.array([asked.value[tree][5][i] for i in found], pa.int64()),
                    "at": pa.array([int(ids[0])] * len(found), pa.int64()), "rows": pa.array([packed[a:z].tobytes() for a, z in zip(first.tolist(), ends)], pa.binary())})
    return run


NODES = "tree int, node long, feature int, split array<double>, gain double, weight double, total double, square double"


def _node_table(tree: int, levels: list, rules: Rules) -> pa.Table:
    ids, feature, left, gain, weight, total, square = (np.concatenate(x) for x in zip(*levels))
    arity = np.array([*rules.arity, -1])[feature]
    sets = left & (arity >= 0)[:, None]
    lengths = np.where(feature < 0, 0, np.where(arity >= 0, sets.sum(1), 1))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.zeros(offsets[-1])
    row, code = np.nonzero(sets)
    values[np.repeat(arity >= 0, lengths)] = code
    for j, cuts in enumerate(rules.cuts):
        mine = np.flatnonzero((feature == j) & (arity < 0))
        values[offsets[mine]] = np.array(cuts)[left[mine].sum(1) - 1] if len(mine) else 0
    return pa.table({"tree": pa.array(np.full(len(ids), tree), pa.int32()), "node": pa.array(ids, pa.int64()), "feature": pa.array(feature, pa.int32()),
                     "split": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)), "gain": gain, "weight": weight,
                     "total": total, "square": square})


def _grow_group(rules: Rules, kind: list):
    def run(key, table):
        tree, root = (k.as_py() for k in key)
        table = table.sort_by("at")
        x = np.frombuffer(b"".join(b.as_py() for b in table["rows"]), kind)
        return _node_table(tree, grown(np.ascontiguousarray(x["c"]), x["y"].astype(float), x["w"], root, rules, tree), rules)
    return run


SAVED = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
         "leftChild int, rightChild int, featureIndex int, split array<double>, numCategories int")


def _numbered(rules: Rules):
    """The nodes of a tree as Spark ML saves them, numbered in preorder."""
    def run(key, table):
        node = table["node"].to_numpy()
        depth = np.frexp(node.astype(float))[1] - 1
        order = np.lexsort((depth, node << (depth.max() - depth)))
        table, node = table.take(order), node[order]
        inner = table["feature"].to_numpy() >= 0
        by_id = np.argsort(node)
        kid = [np.where(inner, by_id[np.minimum(np.searchsorted(node[by_id], 2 * node + i), len(node) - 1)], -1) for i in range(2)]
        w, s, q = (table[c].to_numpy() for c in ("weight", "total", "square"))
        mean, scale = s / w, 2.0 if rules.classes else 1.0
        stats = np.stack([w - s, s] if rules.classes else [w, s, q], axis=1)
        size = stats.shape[1]
        return pa.table({
            "treeID": pa.array(np.full(len(node), key[0].as_py()), pa.int32()), "id": pa.array(np.arange(len(node)), pa.int32()),
            "prediction": (mean > 0.5).astype(float) if rules.classes else mean,
            "impurity": scale * np.maximum(q / w - mean * mean, 0.0),
            "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * size, pa.int32()), pa.array(stats.ravel())),
            "rawCount": pa.array(w.astype(np.int64)), "gain": np.where(inner, scale * table["gain"].to_numpy() / w, -1.0),
            "leftChild": pa.array(kid[0], pa.int32()), "rightChild": pa.array(kid[1], pa.int32()), "featureIndex": table["feature"],
            "split": table["split"], "numCategories": pa.array(np.array([*rules.arity, -1])[table["feature"].to_numpy()], pa.int32())})
    return run


def _chunks(nodes: list, most: int):
    """Pairs of (tree, node) as {tree: nodes}, at most ``most`` pairs together."""
    for i in range(0, len(nodes), most):
        some: dict = {}
        for tree, at in nodes[i:i + most]:
            some.setdefault(tree, []).append(at)
        yield some


def grow(rows: DataFrame, trees: int, rules: Rules) -> DataFrame:
    """The nodes (``SAVED``) of ``trees`` trees on all of ``rows`` (see ``binned``)."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("most"), F.max(F.col("label").cast("float").cast("double") != F.col("label")).alias("wide")).first()
    kind = [("c", np.uint8 if max(rules.bins) <= 256 else np.uint16, (len(rules.bins),)), ("w", np.uint8 if size["most"] <= 64 else np.uint32),
            ("y", np.float64 if size["wide"] else np.float32)]
    tops, groups = {t: Top.new(max(rules.bins)) for t in range(trees)}, []
    open_, level, most = [(t, 0) for t in range(trees)], 0, max(1, LEVEL_CELLS // sum(rules.bins))
    if size["n"] <= GROUP_ROWS:
        open_, groups = [], [(t, 0, size["n"]) for t in range(trees)]
    while open_:
        below = []
        for some in _chunks(open_, most):
            asked = sc.broadcast({t: tops[t].asked(nodes) for t, nodes in some.items()})
            sums = rows.mapInArrow(_statistics(asked, rules), "tree int, sums binary")
            said = sums.repartition(min(len(some), sc.defaultParallelism), "tree").groupBy("tree").applyInArrow(_decide(asked, rules, level), "tree int, said binary")
            for r in said.collect():
                tree, nodes = r["tree"], some[r["tree"]]
                for i, (at, feature, left, *totals, binned_rows) in enumerate(zip(nodes, *pickle.loads(r["said"]))):
                    if binned_rows <= GROUP_ROWS and level < rules.depth:
                        groups.append((tree, at, int(binned_rows)))
                    elif feature >= 0:
                        below += [(tree, a) for a in tops[tree].split(at, int(feature), left, totals)]
                    else:
                        tops[tree].feature[at], tops[tree].totals[at] = -1, totals
            asked.unpersist()
        open_, level = below, level + 1
    nodes = spark.createDataFrame(pa.concat_tables([_top_table(t, top, rules) for t, top in tops.items()]), NODES)
    if groups:
        by_tree: dict = {}
        for t, at, _ in groups:
            by_tree.setdefault(t, []).append(at)
        asked = sc.broadcast({t: tops[t].asked(some) for t, some in by_tree.items()})
        count = min(len(groups), max(4 * sc.defaultParallelism, -(-sum(n for *_, n in groups) // GROUPS_ROWS)))
        packed = rows.mapInArrow(_handed(asked, rules, kind), "tree int, node long, at long, rows binary")
        grown_ = packed.repartition(count, "tree", "node").groupBy("tree", "node").applyInArrow(_grow_group(rules, kind), NODES)
        nodes = nodes.unionByName(grown_)
    return nodes.groupBy("tree").applyInArrow(_numbered(rules), SAVED)


def _top_table(tree: int, top: Top, rules: Rules) -> pa.Table:
    done = [a for a, x in enumerate(top.totals) if x is not None]
    gain, weight, total, square = (np.array([top.totals[a][i] for a in done], float) for i in range(4))
    return _node_table(tree, [(np.array([top.ids[a] for a in done], np.int64), np.array([top.feature[a] for a in done], np.int64),
                               np.array([top.left[a] for a in done]).reshape(len(done), -1) if done else np.zeros((0, max(rules.bins)), bool),
                               gain, weight, total, square)], rules)
