"""The forest as flat arrays: per-tree predictions (M7) and exact path-dependent
Shapley values (M8), evaluated in Arrow-batched tasks.

The tree structure is read from Spark ML's own persisted model (one parquet
row per node), turned into flat numpy arrays on the driver (model-sized:
at most trees x 2^(depth+1) nodes, independent of the data size) and
broadcast.  Rows stay distributed; each task walks all trees for a batch.

A split sends a row left by a threshold or, for a categorical feature, by a set of codes.
"""

from __future__ import annotations

import itertools
import math
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.functions.partitioning import spread
from casebook.session import checkpoint_dir, ship_package


@dataclass
class FlatForest:
    feature: np.ndarray    # integer, -1 for a leaf
    threshold: np.ndarray  # float64, go left when x <= threshold (no set given)
    left: np.ndarray       # integer, global node index
    right: np.ndarray
    value: np.ndarray      # leaf value (P(class 1) or mean), per node
    cover: np.ndarray      # weighted training count at the node
    roots: np.ndarray      # int64, one per tree
    depth: int
    n_features: int
    set_row: np.ndarray | None = None  # int32 per node: row of ``sets``, -1 for a threshold
    sets: np.ndarray | None = None     # bool (set splits, codes): the codes that go left

    def __post_init__(self):
        if self.set_row is None:
            self.set_row, self.sets = np.full(len(self.feature), -1, np.int32), np.zeros((0, 1), bool)

    def walked(self) -> FlatForest:
        """Without the covers, which predictions do not need: what every worker holds to score."""
        return replace(self, cover=self.cover[:0])


def flatten_forest(forest_model, spark, positive_class: int = 1) -> FlatForest:
    """Read the persisted trees back as flat arrays (driver side, model-sized)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/casebook-forest/{uuid.uuid4().hex}"
    forest_model.write().overwrite().save(path)
    return read_forest(path, spark, int(forest_model.numFeatures), hasattr(forest_model, "numClasses"), positive_class)


def read_forest(path: str, spark, n_features: int, is_clf: bool, positive_class: int = 1) -> FlatForest:
    """The flat arrays of a forest saved at ``path``."""
    stats = F.col("nodeData.impurityStats")
    if is_clf:
        cover = F.aggregate(stats, F.lit(0.0), lambda acc, x: acc + x)
        value = F.when(cover > 0, F.get(stats, positive_class) / cover).otherwise(F.lit(0.0))
    else:
        cover = F.get(stats, 0)
        value = F.col("nodeData.prediction")
    inner = F.col("nodeData.leftChild") >= 0
    arity, split = F.col("nodeData.split.numCategories"), F.col("nodeData.split.leftCategoriesOrThreshold")
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", F.col("nodeData.id").alias("id"), value.alias("value"), F.coalesce(cover, F.lit(0.0)).alias("cover"),
                     F.col("nodeData.leftChild").alias("leftChild"), F.col("nodeData.rightChild").alias("rightChild"),
                     F.when(inner, F.col("nodeData.split.featureIndex")).otherwise(-1).alias("feature"),
                     F.coalesce(F.when(inner & (arity < 0), F.get(split, 0)), F.lit(0.0)).alias("threshold"),
                     F.coalesce(F.when(inner, arity), F.lit(-1)).alias("arity"),
                     F.coalesce(F.when(inner & (arity >= 0), split), F.array().cast("array<double>")).alias("goes_left"))
             .orderBy("treeID", "id").toArrow())
    column = {c: nodes[c].to_numpy() for c in nodes.column_names if c != "goes_left"}
    goes_left = nodes["goes_left"].combine_chunks()
    # Node ids are dense preorder indexes within each tree, so a node's global
    # index is its tree's offset plus its id.
    tree = column["treeID"]
    ids = column["id"].astype(np.int64)
    n = len(ids)
    trees, first = np.unique(tree, return_index=True)
    offset = np.zeros(int(trees.max()) + 1, dtype=np.int64)
    offset[trees] = first
    if not np.array_equal(ids, np.arange(n) - offset[tree]):
        raise ValueError("unexpected node numbering in the persisted forest")
    internal = column["leftChild"] >= 0
    arity = column["arity"].astype(np.int64)
    by_set = np.flatnonzero(arity >= 0)
    set_row = np.full(n, -1, np.int32)
    set_row[by_set] = np.arange(len(by_set))
    sets = np.zeros((len(by_set), max(1, arity.max(initial=1))), bool)
    sets[np.repeat(set_row, goes_left.value_lengths().to_numpy()), goes_left.flatten().to_numpy().astype(np.int64)] = True
    base = offset[tree]
    feature = column["feature"].astype(np.int32)
    thr = column["threshold"].astype(float)
    left = np.where(internal, base + column["leftChild"], np.arange(n)).astype(np.int32)
    right = np.where(internal, base + column["rightChild"], np.arange(n)).astype(np.int32)
    value, cover = column["value"].astype(float), column["cover"].astype(float)
    roots = first.astype(np.int64)
    depth, frontier = 0, roots
    while len(frontier):
        inner = frontier[feature[frontier] >= 0]
        frontier = np.concatenate([left[inner], right[inner]])
        depth += 1 if len(frontier) else 0
    return FlatForest(feature, thr, left, right, value, cover, roots, depth, n_features, set_row, sets)


def joined(parts: list[FlatForest]) -> FlatForest:
    """One forest of the trees of all ``parts``, in their order."""
    at = np.cumsum([0, *(len(p.feature) for p in parts)])
    rows = np.cumsum([0, *(len(p.sets) for p in parts)])
    codes = max(p.sets.shape[1] for p in parts)
    return FlatForest(
        *(np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "threshold")),
        *(np.concatenate([getattr(p, c) + np.int32(a) for p, a in zip(parts, at)]) for c in ("left", "right")),
        *(np.concatenate([getattr(p, c) for p in parts]) for c in ("value", "cover")),
        np.concatenate([p.roots + a for p, a in zip(parts, at)]), max(p.depth for p in parts), parts[0].n_features,
        np.concatenate([np.where(p.set_row >= 0, p.set_row + np.int32(r), np.int32(-1)) for p, r in zip(parts, rows)]),
        np.concatenate([np.pad(p.sets, ((0, 0), (0, codes - p.sets.shape[1]))) for p in parts]))


def tree_values(ff: FlatForest, X: np.ndarray) -> np.ndarray:
    """Per-tree predictions, shape (rows, trees): tree by tree, so that a tree's nodes stay in a
    core's cache while all rows walk it.  A leaf is its own child."""
    n, m = X.shape
    out, codes = np.empty((n, len(ff.roots))), ff.sets.shape[1]
    flat, at, sets = np.ascontiguousarray(X).ravel(), np.arange(n) * m, ff.sets.ravel()
    for t, (first, end) in enumerate(zip(ff.roots.tolist(), [*ff.roots[1:].tolist(), len(ff.feature)])):
        mine = slice(first, end)
        feature, threshold, set_row = np.maximum(ff.feature[mine], 0).astype(np.int64), ff.threshold[mine], ff.set_row[mine].astype(np.int64)
        by_set, kids = set_row >= 0, np.stack([ff.right[mine], ff.left[mine]], axis=1).ravel().astype(np.int64) - first
        node = np.zeros(n, np.int64)
        for _ in range(ff.depth):
            x = flat.take(at + feature.take(node))
            left = x <= threshold.take(node)
            some = np.flatnonzero(by_set.take(node))
            if len(some):
                code = np.clip(x.take(some), 0, codes - 1).astype(np.int64)
                left[some] = sets.take(set_row.take(node.take(some)) * codes + code)
            node = kids.take(2 * node + left)
        out[:, t] = ff.value[mine].take(node)
    return out


#: Cells of all coalition tables of one block together (8 bytes each).
TABLE_CELLS = 1 << 24
TREES_AT_ONCE = 8


@dataclass
class Game:
    """Exact path-dependent Shapley values of a forest's predictions.

    The splits cut each feature into cells, the features together into a grid; a row's
    values depend on its cell alone.  For every coalition S of features (bit j: feature j)
    a table over the cells of S holds E[f | x_S], so a row costs 2^M lookups, whatever the
    forest's size.  The grid is dealt into blocks whose tables together have at most
    ``cells`` cells; a block's tables are built when a row first needs them and the last
    ones are kept.
    """
    forest: FlatForest
    cells: int = TABLE_CELLS
    _kept: dict = field(default_factory=dict)

    def __post_init__(self):
        ff, by_set = self.forest, self.forest.set_row >= 0
        self.by_set = [bool((by_set & (ff.feature == j)).any()) for j in range(ff.n_features)]
        self.edges = [np.arange(ff.sets.shape[1] - 1) + 0.5 if s else np.unique(ff.threshold[ff.feature == j]) for j, s in enumerate(self.by_set)]
        self.sizes = [len(e) + 1 for e in self.edges]
        self.side = list(self.sizes)  # cells of a block along each feature
        while math.prod(k + 2 for k in self.side) > self.cells and max(self.side) > 1:
            widest = int(np.argmax(self.side))
            self.side[widest] = -(-self.side[widest] // 2)
        self.base = sum(float((v * r.prod(axis=1)).sum()) for v, r, *_ in map(self.leaves, self.parts()))

    def __getstate__(self):
        return self.__dict__ | {"_kept": {}}

    @property
    def blocks(self) -> int:
        return math.prod(-(-n // k) for n, k in zip(self.sizes, self.side))

    def parts(self) -> list[np.ndarray]:
        return [self.forest.roots[i:i + TREES_AT_ONCE] for i in range(0, len(self.forest.roots), TREES_AT_ONCE)]

    def cell_of(self, X: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def block_of(self, cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for j, (n, k) in enumerate(zip(self.sizes, self.side)):
            out = out * -(-n // k) + cell[:, j] // k
        return out

    def leaves(self, roots: np.ndarray):
        """Of the leaves below ``roots``: value / number of trees, the cover ratios by feature,
        the accepted cells [start, end) by feature, and for features split by sets a mask."""
        ff, M = self.forest, self.forest.n_features
        node, ratio = roots.copy(), np.ones((len(roots), M))
        start, end = np.zeros((len(roots), M), np.int64), np.tile(np.array(self.sizes, np.int64), (len(roots), 1))
        masks = {j: np.ones((len(roots), self.sizes[j]), bool) for j, s in enumerate(self.by_set) if s}
        done = []
        while len(node):
            f = ff.feature[node]
            leaf, inner = f < 0, np.flatnonzero(f >= 0)
            done.append((ff.value[node[leaf]] / len(ff.roots), ratio[leaf], start[leaf], end[leaf], {j: m[leaf] for j, m in masks.items()}))
            nd, fi, at = node[inner], f[inner], np.arange(len(inner))
            sides = []
            for child, is_left in ((ff.left[nd], True), (ff.right[nd], False)):
                r, s, e = ratio[inner].copy(), start[inner].copy(), end[inner].copy()
                m = {j: x[inner].copy() for j, x in masks.items()}
                r[at, fi] *= np.divide(ff.cover[child], ff.cover[nd], out=np.zeros(len(nd)), where=ff.cover[nd] > 0)
                for j in range(M):
                    mine = np.flatnonzero(fi == j)
                    if j in m:
                        m[j][mine] &= ff.sets[ff.set_row[nd[mine]]] == is_left
                        continue
                    cut = np.searchsorted(self.edges[j], ff.threshold[nd[mine]]) + 1
                    if is_left:
                        e[mine, j] = np.minimum(e[mine, j], cut)
                    else:
                        s[mine, j] = np.maximum(s[mine, j], cut)
                sides.append((child, r, s, e, m))
            (a, *x), (b, *y) = sides
            node = np.concatenate([a, b])
            ratio, start, end = (np.concatenate(z) for z in zip(x[:3], y[:3]))
            masks = {j: np.concatenate([x[3][j], y[3][j]]) for j in masks}
        return tuple(np.concatenate(z) for z in zip(*(d[:4] for d in done))) + ({j: np.concatenate([d[4][j] for d in done]) for j in masks},)

    def tables(self, block: int) -> list[np.ndarray]:
        """Per coalition: E[f | x_S], flat over the block's cells of the features of S.

        To coalition S a leaf pays v * (product of its cover ratios outside S) on the box of
        cells it accepts in S (a set: on every run of codes).  Boxes are added as
        differences at their corners, which running sums along each axis then fill."""
        if block in self._kept:
            return self._kept[block]
        M, low, rest = self.forest.n_features, [], block
        for n, k in reversed(list(zip(self.sizes, self.side))):
            rest, i = divmod(rest, -(-n // k))
            low.insert(0, i * k)
        side = [min(k, n - a) for n, k, a in zip(self.sizes, self.side, low)]
        sums = [np.zeros(math.prod(side[j] + 1 for j in _members(s, M))) for s in range(1 << M)]
        for roots in self.parts():
            value, ratio, start, end, masks = self.leaves(roots)
            runs = {}
            for j, m in masks.items():
                edge = np.diff(np.pad(m[:, low[j]:low[j] + side[j]].astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (leaf, first), (_, past) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                runs[j] = (np.searchsorted(leaf, np.arange(len(value) + 1)), first, past)
            for s in range(1 << M):
                inside, who, boxes = _members(s, M), np.arange(len(value)), []
                for j in inside:
                    if j in runs:
                        bounds, first, past = runs[j]
                        times = (bounds[1:] - bounds[:-1])[who]
                        at = np.arange(times.sum()) + np.repeat(bounds[who] - (np.cumsum(times) - times), times)
                        boxes = [(np.repeat(a, times), np.repeat(z, times)) for a, z in boxes] + [(first[at], past[at])]
                        who = np.repeat(who, times)
                    else:
                        boxes.append(tuple(np.clip(x[who, j] - low[j], 0, side[j]) for x in (start, end)))
                pay = value[who] * ratio[who][:, [j for j in range(M) if j not in inside]].prod(axis=1)
                pay = np.where(np.logical_and.reduce([a < z for a, z in boxes] or [np.ones(len(pay), bool)]), pay, 0.0)
                for corner in itertools.product((0, 1), repeat=len(inside)):
                    at = np.zeros(len(pay), np.int64)
                    for j, box, last in zip(inside, boxes, corner):
                        at = at * (side[j] + 1) + box[last]
                    sums[s] += np.bincount(at, weights=-pay if sum(corner) % 2 else pay, minlength=len(sums[s]))
        out = []
        for s in range(1 << M):
            box = sums[s].reshape([side[j] + 1 for j in _members(s, M)])
            for axis in range(box.ndim):
                box = np.cumsum(box, axis=axis)
            out.append(box[tuple(slice(0, -1) for _ in range(box.ndim))].ravel())
        self._kept.clear()
        self._kept[block] = out
        return out

    def shapley(self, X: np.ndarray) -> np.ndarray:
        """Shapley values, shape (rows, M)."""
        M, out = self.forest.n_features, np.zeros(X.shape)
        weight = [math.factorial(k) * math.factorial(M - k - 1) / math.factorial(M) for k in range(M)]
        cell = self.cell_of(X)
        block = self.block_of(cell)
        for b in np.unique(block).tolist():
            rows = np.flatnonzero(block == b)
            local = cell[rows] % np.array(self.side)
            side = [min(k, n - c // k * k) for n, k, c in zip(self.sizes, self.side, cell[rows[0]].tolist())]
            for s, table in enumerate(self.tables(b)):
                at = np.zeros(len(rows), np.int64)
                for j in _members(s, M):
                    at = at * side[j] + local[:, j]
                paid, size = table[at], s.bit_count()
                for j in range(M):
                    out[rows, j] += paid * (weight[size - 1] if s >> j & 1 else -weight[size])
        return out


def _members(s: int, n: int) -> list[int]:
    return [j for j in range(n) if s >> j & 1]


def per_tree_stats(bundle, df: DataFrame, keys, spark) -> DataFrame:
    """M7 core: forest mean and population std over the trees, per row."""
    ship_package(spark)
    b = spark.sparkContext.broadcast(bundle.flat(spark).walked())
    cols = bundle.model_columns()
    keys = list(keys)
    x = bundle.numeric_inputs(df).select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    schema = T.StructType([x.schema[k] for k in keys] + [T.StructField("forest_mean", T.DoubleType()),
                                                         T.StructField("tree_std", T.DoubleType())])

    def run(batches):
        f = b.value
        for pdf in batches:
            v = tree_values(f, pdf[cols].to_numpy(dtype=float))
            out = pdf[keys].copy()
            out["forest_mean"] = v.mean(axis=1)
            out["tree_std"] = v.std(axis=1)
            yield out

    return spread(x).mapInPandas(run, schema)


def mean_values(ff: FlatForest, inputs: list, spark):
    """The forest's mean prediction as a column over its ``inputs``."""
    ship_package(spark)
    b = spark.sparkContext.broadcast(ff.walked())
    return F.pandas_udf(lambda *x: _mean_of(b.value, x), "double")(*[c.cast("double") for c in inputs])


def _mean_of(ff: FlatForest, columns):
    import pandas as pd
    return pd.Series(tree_values(ff, np.stack([np.asarray(c, float) for c in columns], axis=1)).mean(axis=1))


SALTS = 8


def shapley_rows(bundle, df: DataFrame, keys, spark, cells: int = TABLE_CELLS, even: bool = False) -> tuple[DataFrame, float]:
    """M8 core: one row per row of ``df``: its keys, ``_v_<feature>`` (the input as text) and
    ``_phi``, the Shapley values toward the prediction in the order of the features, then
    the prediction; and the base value.  The coalition tables are built in the tasks; a
    grid of several blocks has its rows brought together by block first (a block's rows in
    ``SALTS`` parts, so that a hot one is no single task).  ``even``: the rows are dealt
    evenly already."""
    ship_package(spark)
    rules = Game(bundle.flat(spark), cells)
    game = spark.sparkContext.broadcast(rules)
    cols = bundle.model_columns()
    keys = list(keys)
    feats = list(bundle.features)
    shown = [F.col(f"_own.{c}").cast("string").alias(f"_v_{c}") if "_own" in df.columns
             else F.col(c).cast("string").alias(f"_v_{c}") for c in feats]
    inputs = [f"_x_{c}" for c in cols]
    x = bundle.numeric_inputs(df).select(*keys, *shown, *[F.col(c).cast("double").alias(i) for c, i in zip(cols, inputs)])
    if rules.blocks > 1:
        block = F.pandas_udf(lambda *v: _block_of(game.value, v), "long")
        x = x.withColumn("_block", block(*inputs)).withColumn("_salt", F.pmod(F.xxhash64(*keys, *inputs), F.lit(SALTS)))
        x = x.repartition("_block", "_salt").sortWithinPartitions("_block").drop("_block", "_salt")
    elif not even:
        x = spread(x)
    phi = F.pandas_udf(lambda *v: _shapley_of(game.value, v), "array<double>")
    return x.withColumn("_phi", phi(*inputs)).drop(*inputs), rules.base


def paid(features) -> Column:
    """Of a row of ``shapley_rows``: an array of (feature, value, shap_value)."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_v_{c}").alias("value"), F.get("_phi", j).alias("shap_value"))
                     for j, c in enumerate(features)])


def attributions(bundle, df: DataFrame, keys, spark, cells: int = TABLE_CELLS) -> DataFrame:
    """M8: per row and feature, the Shapley value toward the prediction, long
    form (keys, feature, value, shap_value), plus the base value."""
    rows, base = shapley_rows(bundle, df, keys, spark, cells)
    a = rows.select(*keys, F.get("_phi", len(bundle.features)).alias("prediction"), F.explode(paid(bundle.features)).alias("_a"))
    return a.select(*keys, "_a.feature", "_a.value", "_a.shap_value", F.lit(base).alias("base_value"), "prediction")


def _shapley_of(game: Game, columns):
    import pandas as pd
    phi = game.shapley(np.stack([np.asarray(c, float) for c in columns], axis=1))
    return pd.Series(list(np.column_stack([phi, game.base + phi.sum(axis=1)])))


def _block_of(game: Game, columns):
    import pandas as pd
    return pd.Series(game.block_of(game.cell_of(np.stack([np.asarray(c, float) for c in columns], axis=1))))
