"""Histogram sort into shards of near-equal bytes (operator 6).

Rows are ordered by (hash of the text, hash of the id), so equal texts stand next
to each other.  The boundaries between shards are found by probing: each round
counts, in one pass over a small key table, the exact bytes below evenly spaced
candidate boundaries inside the open interval of every splitter, and narrows the
interval, until a candidate is within tolerance of the wanted share.  An interval
that has shrunk to one text is refined by the id hash: a group of copies on which a
boundary falls is cut there and lies in two shards, however small it is, and one larger
than a shard in several.  All other groups stay whole.  Then the rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.scratch import stored

TOP = 1 << 63  # keys are hashes in [0, TOP)


@dataclass
class Interval:
    """Where a splitter may lie: keys in [lo, hi) of ``group`` (None: text hashes;
    else id hashes of the rows with that text hash); ``below``: bytes before lo."""
    lo: int
    hi: int
    below: int
    group: int | None = None

    def edge(self, key: int) -> tuple[int, int]:
        if self.group is None:
            return (key, 0) if key < TOP else (TOP - 1, TOP - 1)
        return (self.group, key) if key < TOP else (self.group + 1, 0)

    def rows(self, text_key: Column, id_key: Column) -> tuple[Column, Column]:
        """(condition that a row lies in the interval, the key that is probed)."""
        if self.group is None:
            return (text_key >= F.lit(self.lo)) & (text_key <= F.lit(self.hi - 1)), text_key
        return ((text_key == F.lit(self.group)) & (id_key >= F.lit(self.lo)) & (id_key <= F.lit(self.hi - 1))), id_key


def count_probes(keys: DataFrame, open_intervals: list[Interval], probes: int) -> list[dict[int, int]]:
    """Per interval the exact bytes in each of its cells; one pass, at most
    ``len(open_intervals) * probes`` rows come back."""
    text_key, id_key = F.col("text_key"), F.col("id_key")
    cell = F.lit(None).cast("long")
    for i, interval in reversed(list(enumerate(open_intervals))):
        inside, key = interval.rows(text_key, id_key)
        width = -(-(interval.hi - interval.lo) // probes)
        at = F.call_function("div", key - F.lit(interval.lo), F.lit(width))
        cell = F.when(inside, F.lit(i * probes) + at).otherwise(cell)
    rows = (keys.select(cell.alias("cell"), "size").where(F.col("cell").isNotNull())
            .groupBy("cell").agg(F.sum("size").alias("bytes")).collect())
    out: list[dict[int, int]] = [{} for _ in open_intervals]
    for r in rows:
        i, at = divmod(r["cell"], probes)
        out[i][at] = r["bytes"]
    return out


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 64) -> list[tuple[int, int]]:
    """The first (text_key, id_key) of shards 1 .. shards-1.

    Each is within ``tolerance`` of a mean shard's bytes of the even cut, or, where
    rows with equal keys allow no such place, at the nearer edge of those rows.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    state = {i: Interval(0, TOP, 0) for i in wanted}
    found: dict[int, tuple[int, int]] = {}
    if total == 0:
        return [(TOP - 1, TOP - 1)] * (shards - 1)
    while len(found) < len(wanted):
        distinct: dict[tuple, Interval] = {}
        for i in wanted:
            if i not in found:
                s = state[i]
                distinct.setdefault((s.group, s.lo, s.hi), s)
        cells = dict(zip(distinct, count_probes(keys, list(distinct.values()), probes)))
        for i in wanted:
            if i in found:
                continue
            s = state[i]
            inside = cells[(s.group, s.lo, s.hi)]
            width = -(-(s.hi - s.lo) // probes)
            below, at = s.below, 0
            for at in sorted(inside):
                if below + inside[at] >= wanted[i]:
                    break
                below += inside[at]
            lo, hi = s.lo + at * width, min(s.lo + (at + 1) * width, s.hi)
            above = below + inside.get(at, 0)
            if min(wanted[i] - below, above - wanted[i]) <= slack or (s.group is not None and hi - lo == 1):
                found[i] = s.edge(lo if wanted[i] - below <= above - wanted[i] else hi)
            elif s.group is None and hi - lo == 1:
                state[i] = Interval(0, TOP, below, lo)
            else:
                state[i] = Interval(lo, hi, below, s.group)
    return [found[i] for i in sorted(found)]


OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, key: str = "doc_id", text: str = "text",
          bucket_rows: int = 200_000) -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot and grown_shard (null: the
    law is ``bytes``).

    Size is the text's UTF-8 bytes (null text: none) plus 8.  Null and empty texts
    are equal.  Slots number a shard's rows from 0 without gaps, in key order
    inside each of its buckets; the buckets (by id hash, about ``bucket_rows`` rows
    each) are what moves, so no task holds a whole shard.  Rows that are equal in
    id and text stay together.  All columns of ``docs`` are kept, but for those
    named like an added one.  An empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in OUT]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(body).cast("long") + 8).alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        F.shiftrightunsigned(F.xxhash64(body), 1).alias("_text_key"),
        F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(f"`{key}`")), 1).alias("_id_key"))
    keys = stored(keyed.select(F.col("_text_key").alias("text_key"), F.col("_id_key").alias("id_key"),
                               F.col("_size").alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)

    def shard_of(text_key: str, id_key: str) -> Column:
        """Binary search among the splitters as nested conditions."""
        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            a, b = splitters[mid]
            after = F.col(text_key) >= F.lit(a) if b == 0 else (
                (F.col(text_key) > F.lit(a)) | ((F.col(text_key) == F.lit(a)) & (F.col(id_key) >= F.lit(b))))
            return F.when(after, pick(mid + 1, hi)).otherwise(pick(lo, mid))
        return pick(0, len(splitters))

    buckets = max(1, -(-keys.count() // (shards * bucket_rows)))
    bucket = lambda id_key: F.pmod(F.col(id_key), F.lit(buckets))
    per_bucket = (keys.groupBy(shard_of("text_key", "id_key").alias("_shard"), bucket("id_key").alias("_bucket"))
                  .agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    offsets = stored(offsets, "shard-offsets")  # one row for each of shards x buckets
    if shards * buckets <= 1_000_000:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_text_key", "_id_key", F.col(f"`{key}`"))
    return (keyed.withColumn("_shard", shard_of("_text_key", "_id_key")).withColumn("_bucket", bucket("_id_key"))
            .withColumn("_place", F.row_number().over(inside) - 1)
            .join(offsets, ["_shard", "_bucket"])
            .select(*[F.col(f"`{c}`") for c in kept], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"),
                    (F.col("_first") + F.col("_place")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
