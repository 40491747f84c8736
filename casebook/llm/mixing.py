"""Temperature mixing of sources (operator 7).

Source weights are the token shares raised to an exponent, w ~ p^a with a in [0, 1]
(1: as found, 0: all equal).  The exponent is bisected to the flattest mixture that
keeps the entropy at most at its target and shows no source more often than the
repetition limit.  The weights become token budgets, and each budget is filled with
block permutations: whole passes over the source, then one partial pass that ends
where the budget does.  A pass visits the source's blocks in a pseudo-random order
and the documents of a block in another; both orders are hashes, so every row is
decided on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.scratch import stored

PROBES = 15  # exponents tried at once: four bits of the bisection in one pass
ROUNDS = 8


def share_sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: sum of p^a, sum of p^a ln(p^a), largest p^(a-1).

    One pass over the source table (one row a source), summed in Spark, so that the
    number of sources may grow.
    """
    p = F.col("share")
    cols = []
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"e{i}"), F.max(F.pow(p, F.lit(a - 1.0))).alias(f"r{i}")]
    row = shares.agg(*cols, F.max("share").alias("top")).first()
    return [(row[f"z{i}"], row[f"e{i}"], row[f"r{i}"] / row["top"] ** (a - 1.0)) for i, a in enumerate(exponents)]


def find_exponent(shares: DataFrame, repeat_limit: float | None, target_entropy: float | None) -> float:
    """The least exponent in [0, 1] whose mixture has entropy (nats) of at most
    ``target_entropy`` and repeats no source more than ``repeat_limit`` times when
    the largest source is read once."""
    def allowed(z: float, e: float, repeat: float) -> bool:
        entropy = -e / z + _ln(z)
        return ((repeat_limit is None or repeat <= repeat_limit)
                and (target_entropy is None or entropy <= target_entropy))

    if allowed(*share_sums(shares, [0.0])[0]):
        return 0.0
    lo, hi = 0.0, 1.0  # lo: not allowed; hi: allowed, or the end of the range
    for _ in range(ROUNDS):
        tries = [lo + (hi - lo) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
        good = [allowed(*s) for s in share_sums(shares, tries)]
        k = good.index(True) if True in good else PROBES
        lo, hi = ([lo] + tries)[k], (tries + [hi])[k]
    return hi


def _ln(x: float) -> float:
    import math

    return math.log(x)


def _hash(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


ADDED = ("epoch", "block_order", "place_order", "tokens", "weight", "exponent")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text",
        repeat_limit: float | None = 1.5, target_entropy: float | None = None, budget: float | None = None,
        block_docs: int = 1024, max_blocks: int = 4096, seed: int = 0) -> DataFrame:
    """``docs``, each row as often as the mixture shows it, plus epoch (0, 1, ...),
    block_order, place_order (sort by epoch, block_order, place_order for a source's
    order), tokens (words of the text), weight of its source and the exponent.

    ``budget``: tokens of the mixture; None: the least budget with which every
    source is read at least once, so no document is left out.  A partial pass takes
    whole blocks in their order and, from the block in which the budget ends, the
    first documents that fit.  Rows that are equal in id and text are taken
    together.  A null source is a source of its own; null or wordless text has 0
    tokens and appears in the whole passes; if a corpus has no token at all every
    row appears once.  Columns named like an added one are replaced.  An empty table
    stays empty.
    """
    if repeat_limit is not None and repeat_limit < 1:
        raise ValueError("repeat_limit must be at least 1")
    kept = [c for c in docs.columns if c not in ADDED]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # A null source cannot equal any text after the marker.
    origin = F.when(F.col(f"`{source}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(f"`{source}`").cast("string")))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], origin.alias("_source"),
                       F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"),
                       F.xxhash64(F.col(f"`{key}`"), body).alias("_row"))
    light = stored(rows.select("_source", "_tokens", "_row"), "mix-rows")
    totals = stored(light.groupBy("_source").agg(F.sum("_tokens").alias("total"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    overall = totals.agg(F.sum("total").alias("t"), F.count(F.lit(1)).alias("n"), F.max("total").alias("m")).first()
    tokens = overall["t"] or 0
    shares = totals.where("total > 0").withColumn("share", F.col("total") / F.lit(float(max(tokens, 1))))
    exponent = find_exponent(shares, repeat_limit, target_entropy) if tokens else 1.0
    z = share_sums(shares, [exponent])[0][0] if tokens else 1.0
    if budget is None:
        # w_i / p_i is least for the largest source: it is read exactly once.
        budget = tokens / ((overall["m"] / tokens) ** (exponent - 1.0) / z) if tokens else 0.0

    plan = totals.join(shares.select("_source", "share"), "_source", "left").select(
        "_source", "total", F.coalesce(F.pow("share", F.lit(exponent)) / F.lit(z), F.lit(0.0)).alias("weight"),
        F.least(F.ceil(F.col("docs") / block_docs), F.lit(max_blocks)).cast("long").alias("blocks"))
    wanted = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("weight") * F.lit(float(budget)) / F.col("total"))
    # A hair under a whole pass, left by the powers, is a whole pass.
    plan = plan.withColumn("_passes", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(
        F.when(F.abs(wanted - F.round(wanted)) < 1e-9, F.round(wanted)).otherwise(wanted)))
    plan = plan.select("_source", "total", "weight", "blocks", F.floor("_passes").cast("long").alias("whole"),
                       ((F.col("_passes") - F.floor("_passes")) * F.col("total")).alias("rest"))
    few = overall["n"] <= 10_000

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        return df.join(F.broadcast(p) if few else p, "_source")

    def block_order(epoch: Column) -> Column:
        block = F.pmod(F.xxhash64("_row", F.lit(seed)), F.col("blocks"))
        return _hash(F.lit(seed), F.col("_source"), block, epoch)

    def place_order(epoch: Column) -> Column:
        return _hash(F.lit(seed), F.col("_row"), epoch)

    # Where the partial pass of each source ends: its last block, and its last place in it.
    placed = with_plan(light, plan).select("_source", "_tokens", "rest", block_order(F.col("whole")).alias("_b"),
                                           place_order(F.col("whole")).alias("_p"))
    ordered = Window.partitionBy("_source").orderBy("_b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (placed.groupBy("_source", "_b", "rest").agg(F.sum("_tokens").alias("n"))
              .withColumn("upto", F.sum("n").over(ordered)))
    last = stored(blocks.groupBy("_source", "rest").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("_b"))).alias("end_block"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("before")), "mix-blocks")
    inner = Window.partitionBy("_source").orderBy("_p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at_end = with_plan(placed.drop("rest"), last).where(F.col("_b") == F.col("end_block"))
    cut = stored(at_end.groupBy("_source", "_p", "rest", "before").agg(F.sum("_tokens").alias("n"))
                 .withColumn("upto", F.sum("n").over(inner) + F.coalesce("before", F.lit(0)))
                 .groupBy("_source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("_p"))).alias("end_place")), "mix-cuts")
    plan = stored(plan.join(last.select("_source", "end_block"), "_source", "left").join(cut, "_source", "left"), "mix-plan")

    epochs = F.col("whole")
    b, p = block_order(epochs), place_order(epochs)
    partial = (F.col("rest") > 0) & (F.col("end_block").isNull() | (b < F.col("end_block"))
                                     | ((b == F.col("end_block")) & F.coalesce(p <= F.col("end_place"), F.lit(False))))
    times = F.col("whole") + F.when(partial, 1).otherwise(0)
    shown = with_plan(rows, plan).withColumn("_times", times).where("_times > 0")
    shown = shown.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return shown.select(*[F.col(f"`{c}`") for c in kept], F.col("epoch").cast("int").alias("epoch"),
                        block_order(F.col("epoch")).alias("block_order"), place_order(F.col("epoch")).alias("place_order"),
                        F.col("_tokens").alias("tokens"), "weight", F.lit(exponent).alias("exponent"))
