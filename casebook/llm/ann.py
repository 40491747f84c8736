"""Nearest neighbours by stable projections under a kd-tree (operator 1).

Largest inner product becomes nearest distance: a vector x gets one more component
sqrt(M^2 - |x|^2), M the largest norm, and a query is scaled to norm M; then
|q - x|^2 = 2 M^2 - 2 (M / |q|) <q, x>.  A Gaussian (2-stable) matrix projects to a
few dimensions, where a squared projected distance over the squared true one follows
a chi-square law.

The projected space is cut by a kd-tree, fitted on a bounded sample of rows; every
row is indexed, in the cell it falls in, and a cell's rows are dealt over blocks of
bounded size, each with a kd-tree of its own.  A query first searches its home cell,
then every cell that the bound found there cannot exclude.  In a block the projected
neighbours come in the order of their projected distance: leaves are opened nearest
first, and a point is taken once no unopened leaf can hold a nearer one.  Each is
verified on the original vectors, until the test holds: the next projected distance r
and the distance d of the k-th neighbour so far satisfy P(chi2_m <= r^2 / d^2) >=
``confidence``.

On vectors without structure the leaves exclude nothing and the test alone saves work;
on clustered ones leaves, blocks and cells are left out too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.scratch import stored
from casebook.session import ship_package

LEAF = 32
QUERIES_AT_ONCE = 256
FIRST = 128  # projected neighbours verified before the first test
SPARE = 4  # candidates kept beyond k, re-scored in a fixed order of summation


def chi2_cdf(x: float, m: int) -> float:
    """P(chi2_m <= x) for even m."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= (x / 2) / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


@dataclass
class Space:
    """What every task needs; of fixed size but for the cells (at most a quarter of the sample)."""
    dim: int
    norm: float           # largest norm M
    matrix: np.ndarray    # (dim + 1) x m
    quantile: float       # chi-square quantile of the stopping test
    k: int
    splits: list          # kd-tree of the cells: (axis, value, left, right) or a cell number

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1) @ self.matrix

    def query_points(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]) @ self.matrix[:-1]

    def squared_distance(self, score: np.ndarray, query_norm: np.ndarray) -> np.ndarray:
        return np.maximum(2 * self.norm ** 2 - 2 * self.norm / query_norm * score, 0)

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def walk(node, rows):
            if isinstance(node, int):
                out[rows] = node
                return
            axis, value, left, right = node
            low = points[rows, axis] <= value
            walk(left, rows[low])
            walk(right, rows[~low])

        walk(self.splits, np.arange(len(points)))
        return out


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves: median splits on the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        p = points[rows]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argsort(p[:, axis], kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def kd_splits(points: np.ndarray, cells: int):
    """Nested (axis, value, left, right) with about ``cells`` numbered leaves."""
    number = iter(range(1 << 30))

    def build(p, want):
        if want <= 1 or len(p) < 2:
            return next(number)
        axis = int(np.argmax(p.max(0) - p.min(0)))
        value = float(np.median(p[:, axis]))
        low = p[:, axis] <= value
        if low.all():
            return next(number)
        return (axis, value, build(p[low], want // 2), build(p[~low], want - want // 2))

    return build(points, cells)


def box_distance(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(lo)))
    for axis in range(points.shape[1]):
        x = points[:, axis][:, None]
        gap = np.maximum(np.maximum(lo[None, :, axis] - x, x - hi[None, :, axis]), 0)
        out += gap * gap
    return out


def open_cells(space: Space, q: np.ndarray, bound: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(queries, cells): the cells that a query's k-th score so far cannot exclude."""
    norms = np.sqrt((q * q).sum(1))
    reach = space.squared_distance(bound, norms) * space.quantile
    return box_distance(space.query_points(q), lo, hi) <= reach[:, None]


class Block:
    """The rows of one block: equal vectors once, with their ids in order."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        self.space = space
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        vectors = vectors[first]
        points = space.lifted(vectors)
        leaves = kd_leaves(points, LEAF)
        # Leaf by leaf, so that an opened leaf is a slice.
        place = np.concatenate(leaves)
        self.ends = np.cumsum([0, *map(len, leaves)])
        self.vectors = vectors[place]
        self.points, self.rough = points[place].astype(np.float32), self.vectors.astype(np.float32)
        by = np.argsort(which, kind="stable")
        self.ids = ids[by]
        bounds = np.searchsorted(which[by], np.arange(len(first) + 1))
        self.bounds = np.stack([bounds[place], bounds[place + 1]])
        self.lo = np.array([points[r].min(0) for r in leaves])
        self.hi = np.array([points[r].max(0) for r in leaves])
        self.verified = self.offered = 0

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray) -> list[tuple[int, int, float]]:
        """(query, vec_id, score) of the nearest found; ``bound``: for each query the
        k-th score known from elsewhere (-inf if none)."""
        at = self.space.query_points(q)
        away = box_distance(at, self.lo, self.hi)
        out = []
        for i in range(len(q)):
            found = self.near(q[i], at[i].astype(np.float32), away[i], bound[i])
            # Scores in a fixed order of summation, whatever the block.
            exact = (self.vectors[found] * q[i]).sum(1)
            mine = [(-score, v) for score, r in zip(exact.tolist(), found.tolist())
                    for v in self.ids[self.bounds[0, r]:self.bounds[1, r]][:self.space.k + 1].tolist() if v != qid[i]]
            mine.sort()
            out += [(int(qid[i]), v, -score) for score, v in mine[:self.space.k]]
        return out

    def near(self, q: np.ndarray, at: np.ndarray, away: np.ndarray, bound: float) -> np.ndarray:
        """Rows of the candidates kept for one query."""
        s, n = self.space, len(self.vectors)
        keep = min(s.k + 1 + SPARE, n)
        norm, q32 = math.sqrt(float((q * q).sum())), q.astype(np.float32)
        self.offered += n
        score, row = np.zeros(0, np.float32), np.zeros(0, np.int64)

        def reach() -> float:
            kth = float(np.partition(score, -(s.k + 1))[-(s.k + 1)]) if len(score) > s.k else -math.inf
            kth = max(kth, bound)
            return s.squared_distance(np.float64(kth), norm) * s.quantile if kth > -math.inf else math.inf

        limit, opened, step, order = reach(), 0, 8, np.argsort(away, kind="stable")
        dist, rows = np.zeros(0, np.float32), np.zeros(0, np.int64)
        while opened < len(order) or len(rows):
            more = order[opened:opened + step]
            more = more[away[more] <= limit]
            opened, step = opened + step, 4 * step
            if len(more):
                new = np.concatenate([np.arange(self.ends[x], self.ends[x + 1]) for x in more]) if len(more) < len(order) else np.arange(n)
                gap = self.points[new] - at
                dist, rows = np.concatenate([dist, np.einsum("ij,ij->i", gap, gap)]), np.concatenate([rows, new])
            edge = away[order[opened]] if opened < len(order) else math.inf
            ready = dist <= min(edge, limit)
            if ready.any():
                turn, wait = np.flatnonzero(ready), ~ready & (dist <= limit)
                d, r = dist[turn], rows[turn]
                dist, rows = dist[wait], rows[wait]
                while len(d):
                    size = FIRST if not len(score) else max(FIRST, len(d) // 8)
                    if len(d) > size:
                        part = np.argpartition(d, size)
                        head, tail = part[:size], part[size:]
                    else:
                        head, tail = np.arange(len(d)), np.zeros(0, np.int64)
                    self.verified += len(head)
                    score = np.concatenate([score, self.rough[r[head]] @ q32])
                    row = np.concatenate([row, r[head]])
                    if len(score) > keep:
                        best = np.argpartition(score, -keep)[-keep:]
                        score, row = score[best], row[best]
                    limit = reach()
                    tail = tail[d[tail] <= limit]
                    d, r = d[tail], r[tail]
            some = dist <= limit
            dist, rows = dist[some], rows[some]
            if edge > limit:  # no unopened leaf can pass the test, and every opened point was ready
                break
        return row


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): non-null id, and a vector with finite components, not all zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", projected: int = 24,
            confidence: float = 0.92, cell_rows: int = 65_536, block_rows: int = 16_384,
            sample_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """For each row of ``rows`` for which ``is_query`` (a Column over ``vec_id``) holds:
    query_id, rank (from 1), vec_id, score of the ``k`` largest inner products found
    among all other rows; ties go to the smaller vec_id.

    Vectors that are null, all zero, hold a null or non-finite component, or differ
    in length from the commonest length (ties: the smaller) take no part, nor do rows
    with a null id.  A row is never a candidate of its own id; answers equal in id and
    score count once.
    With fewer candidates than ``k`` all are returned; empty table: no rows.  Columns
    beside the two named are not read.  The kd-tree of the cells is fitted on at most
    ``sample_rows`` rows (those with the smallest id hash); all rows are indexed.  There is
    a cell per ``cell_rows`` rows, as long as the sample has some rows for each: at most
    ``sample_rows`` / 4, beyond which cells take more rows, in more blocks.
    """
    spark = rows.sparkSession
    ship_package(spark)
    result = "query_id long, vec_id long, score double"
    valid = usable(rows, key, vector)
    lengths = valid.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    valid = valid.where(F.size("v") == dim)
    norm = valid.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    n = lengths[0]["n"]
    matrix = np.random.default_rng(seed).normal(size=(dim + 1, projected))
    space = Space(dim, float(norm), matrix, chi2_quantile(confidence, projected), k, 0)
    cells = max(1, min(sample_rows // 4, -(-n // cell_rows)))
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    points = space.lifted(matrix_of(sample["v"].combine_chunks(), dim))
    space.splits = kd_splits(points, cells)

    def place(batches):
        for b in batches:
            if b.num_rows:
                at = space.lifted(matrix_of(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(space.cell_of(at), pa.int32())]
                                                 + [pa.array(at[:, i]) for i in range(projected)],
                                                 names=["vec_id", "v", "cell", *[f"p{i}" for i in range(projected)]])

    axes = [f"p{i}" for i in range(projected)]
    placed = stored(valid.mapInArrow(place, "vec_id long, v array<double>, cell int, " + ", ".join(f"{a} double" for a in axes)), "ann-points")
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{a}") for a in axes],
                                       *[F.max(a).alias(f"hi{a}") for a in axes]).collect()
    boxes.sort(key=lambda r: r["cell"])
    numbers = np.array([r["cell"] for r in boxes])
    lo = np.array([[r[f"lo{a}"] for a in axes] for r in boxes])
    hi = np.array([[r[f"hi{a}"] for a in axes] for r in boxes])
    blocks = np.array([-(-r["n"] // block_rows) for r in boxes])
    # Blocks of a cell: a row's own by id hash; the counts are one row per cell.
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(b)) for c, b in zip(numbers, blocks)], "cell int, blocks long"))
    data = placed.select("vec_id", "v", "cell").join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v",
        F.lit(None).cast("double").alias("bound"))
    asked = placed.where(is_query).select("vec_id", "v", "cell")
    home = asked.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), F.lit(1).alias("kind"),
        "vec_id", "v", F.lit(-math.inf).alias("bound"))

    def search(batches):
        """Rows come sorted by block, a block's data before its queries."""
        here, ids, vectors, index = None, [], [], None
        for b in batches:
            cell, block, kind = (b.column(c).to_numpy() for c in ("cell", "block", "kind"))
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])))
            for a, z in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
                part, where = b.slice(a, z - a), (cell[a], block[a])
                if where != here:
                    here, ids, vectors, index = where, [], [], None
                if kind[a] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    vectors.append(matrix_of(part.column("v"), dim))
                    continue
                if not ids:
                    continue
                index = index or Block(space, np.concatenate(ids), np.concatenate(vectors))
                for i in range(0, part.num_rows, QUERIES_AT_ONCE):
                    some = part.slice(i, QUERIES_AT_ONCE)
                    found = index.search(some.column("vec_id").to_numpy(), matrix_of(some.column("v"), dim),
                                         some.column("bound").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                                      pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        both = data.unionByName(queries)
        return both.repartition(F.col("cell"), F.col("block")).sortWithinPartitions("cell", "block", "kind").mapInArrow(search, result)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Rows with equal ids ask the same home block twice: their answers are the same rows.
    first = stored(searched(home).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "ann-home")
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("last"))
    asked = asked.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
        "vec_id", "v", "cell", F.when(F.col("found") >= k, F.col("last")).otherwise(F.lit(-math.inf)).alias("bound"))

    def spread(batches):
        """Every block of the other cells that the bound leaves open."""
        for b in batches:
            if not b.num_rows:
                continue
            q, bound, own = matrix_of(b.column("v"), dim), b.column("bound").to_numpy(), b.column("cell").to_numpy()
            who, which = np.nonzero(open_cells(space, q, bound, lo, hi) & (numbers[None, :] != own[:, None]))
            times = blocks[which]
            who, which = np.repeat(who, times), np.repeat(which, times)
            block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(who), 4096):
                w, c, x = who[i:i + 4096], which[i:i + 4096], block[i:i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[c], pa.int32()), pa.array(x, pa.int32()), pa.array(np.ones(len(w)), pa.int32()),
                     b.column("vec_id").take(pa.array(w)), b.column("v").take(pa.array(w)), pa.array(bound[w])],
                    names=["cell", "block", "kind", "vec_id", "v", "bound"])

    away = asked.mapInArrow(spread, "cell int, block int, kind int, vec_id long, v array<double>, bound double")
    found = first.unionByName(searched(away).distinct())
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
