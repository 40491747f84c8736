"""A forest given as constants, with the interface of a trained ``ModelBundle``.

Trees are nested tuples (feature, threshold, left, right) with leaves (value, cover);
a row goes left when its input is at most the threshold or, if a set of codes stands in
the threshold's place, one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.ml.features import CATEGORICAL, code_col
from casebook.ml.forest import FlatForest


def tree_column(tree, inputs: list[str]) -> Column:
    if len(tree) == 2:
        return F.lit(float(tree[0]))
    feature, threshold, left, right = tree
    x = F.col(inputs[feature])
    goes_left = x.isin([float(c) for c in sorted(threshold)]) if isinstance(threshold, frozenset) else x <= F.lit(float(threshold))
    return F.when(goes_left, tree_column(left, inputs)).otherwise(tree_column(right, inputs))


def flat_forest(trees, n_features: int, codes: int = 1) -> FlatForest:
    """``codes``: at least as many as any categorical input has."""
    rows: list[list] = []
    roots = []
    sets: dict[int, frozenset] = {}

    def add(tree) -> tuple[int, float, int]:
        at = len(rows)
        rows.append([-1, 0.0, at, at, 0.0, 0.0])
        if len(tree) == 2:
            rows[at][4:] = [float(tree[0]), float(tree[1])]
            return at, float(tree[1]), 0
        feature, threshold, left, right = tree
        (a, ca, da), (b, cb, db) = add(left), add(right)
        if isinstance(threshold, frozenset):
            sets[at] = threshold
        rows[at] = [feature, 0.0 if at in sets else float(threshold), a, b, 0.0, ca + cb]
        return at, ca + cb, 1 + max(da, db)

    depth = 0
    for tree in trees:
        root, _, d = add(tree)
        roots.append(root)
        depth = max(depth, d)
    f, t, a, b, v, c = (np.array(x) for x in zip(*rows))
    set_row, left = np.full(len(rows), -1, np.int32), np.zeros((len(sets), max([codes, *(max(s, default=0) + 1 for s in sets.values())])), bool)
    for i, (at, members) in enumerate(sets.items()):
        set_row[at] = i
        left[i, sorted(members)] = True
    return FlatForest(f.astype(np.int32), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float),
                      c.astype(float), np.array(roots, np.int64), depth, n_features, set_row, left)


@dataclass
class FixedForest:
    kind: str                       # "risk" | "los"
    features: list
    codes: dict                     # categorical feature -> labels in code order
    trees: list
    meta: dict = field(default_factory=dict)

    def model_columns(self) -> list[str]:
        return [code_col(c) if c in CATEGORICAL else c for c in self.features]

    def numeric_inputs(self, df: DataFrame) -> DataFrame:
        """Label codes; a label not listed counts as the first one."""
        out = df
        for c in self.features:
            if c in CATEGORICAL:
                at = F.array_position(F.array(*[F.lit(x) for x in self.codes[c]]), F.col(c))
                out = out.withColumn(code_col(c), F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0)).cast("double"))
        return out

    def scored(self, df: DataFrame) -> DataFrame:
        x = self.numeric_inputs(df)
        inputs = self.model_columns()
        total = sum((tree_column(t, inputs) for t in self.trees[1:]), tree_column(self.trees[0], inputs))
        mean = total / F.lit(float(len(self.trees)))
        if self.kind == "risk":
            return x.withColumn("_p", mean).withColumn("_prediction", F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0))
        return x.withColumn("_prediction", mean)

    def flat(self, spark: SparkSession) -> FlatForest:
        return flat_forest(self.trees, len(self.features), max(map(len, self.codes.values())))
