"""Nearest similar cases (K1), exact, without pairing targets with every record.

Distance (as standardised numeric feature plus one-hot categoricals, Euclidean):
    d^2 = ((x - t) / sigma_t)^2 + 2 * (number of categorical mismatches)
where sigma_t is the population standard deviation of x over the complete
records *plus the target* (0 -> 1), obtained in closed form from one aggregate:
    sigma_t^2 = (n*var + n/(n+1) * (t - mean)^2) / (n + 1).

Take a record among a target's n nearest and the set S of categoricals on which the
two agree.  Among all records that agree on S it is one of the n nearest by x
(ties by key), since any record before it there is nearer or as near.  So for each of
the 2^3 sets S the n nearest values of x on either side suffice, each with its n lowest
keys.  They are neighbours in the order of (S, values on S, x): the distinct places
there are numbered by a range exchange, a target's own place is counted in the same
order, and the n numbers before and after it are an equi-join.  That work does not
depend on how many distinct values x has, so a continuous feature is as good as a
discrete one.  The search runs once per distinct target profile and is joined back.

The sets are searched from the full one down, by their number of mismatches m.  What is not
found yet has m + 1 of them and a d^2 of 2 (m + 1) at least: a target whose n nearest so far
are nearer is done, and only the records that agree on S with an open target are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.indexing import running_count
from casebook.schema import KEY
from casebook.session import stored

# The similarity features.
NUMERIC_FEATURE = "Age"
CATEGORICAL_FEATURES = ("Gender", "Condition", "Procedure")

AGREE = [f"_k{i}" for i in range(len(CATEGORICAL_FEATURES))]
PLACE = ["_g", "_x"]


def _on_sets(df: DataFrame, cols, sets) -> DataFrame:
    """One row for each set S of ``sets``: its number and the values on S (empty elsewhere)."""
    s = F.lit(sets[0]) if len(sets) == 1 else F.explode(F.array(*map(F.lit, sets)))
    out = df.withColumn("_s", s)
    return out.select("*", *[F.when(F.col("_s").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise(F.lit("")).alias(k)
                             for i, (c, k) in enumerate(zip(cols, AGREE))])


def _near(few: DataFrame, profiles: DataFrame, ask: list, sets: list, n: int, key: str) -> DataFrame:
    """The n nearest places on either side of every profile, in all records that agree with it
    on a set of ``sets``: the profile, ``key`` and ``_d2``."""
    asked = _on_sets(profiles, ask[1:], sets)
    # The values on S that profiles have, numbered: places and questions carry the number alone.
    groups = stored(asked.select("_s", *AGREE).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    asked = asked.join(groups, ["_s", *AGREE]).drop("_s", *AGREE)
    here = Window.partitionBy(*PLACE).orderBy("_key")
    # What agrees need not be told.
    told = F.struct("_key", *[F.when(F.col("_s").bitwiseAND(F.lit(1 << i)) == 0, F.col(c)).alias(c) for i, c in enumerate(CATEGORICAL_FEATURES)])
    places = (_on_sets(few, CATEGORICAL_FEATURES, sets).join(groups, ["_s", *AGREE]).select(*PLACE, "_key", told.alias("_c"))
              .withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= n).groupBy(*PLACE).agg(F.collect_list("_c").alias("_near")))

    # Places and questions in one order; a question stands after the place of its own value.
    line = places.select(*PLACE, F.lit(0).alias("_kind"), "_near").unionByName(
        asked.select(*PLACE, F.lit(1).alias("_kind"), F.lit(None).cast(places.schema["_near"].dataType).alias("_near")).distinct())
    line = stored(running_count(line, [*PLACE, "_kind"], F.col("_kind") == 0, "_at"), "line")
    index = line.where("_kind = 0").select("_at", *[F.col(c).alias(f"i{c}") for c in PLACE], "_near")
    spots = line.where("_kind = 1").select(*PLACE, F.explode(F.sequence(F.col("_at") - (n - 1), F.col("_at") + n)).alias("_at"))
    met = spots.join(index, "_at").where(F.col("_g") == F.col("i_g"))
    met = asked.join(met.select(*PLACE, F.col("i_x").alias("_a"), "_near"), PLACE)
    mism = sum(F.coalesce((F.col(f"_c.{c}") != F.col(f"t_{c}")).cast("int"), F.lit(0)) for c in CATEGORICAL_FEATURES)
    d2 = ((F.col("_a") - F.col("_x")) / F.col("_sigma")) ** 2 + F.lit(2.0) * mism
    return met.select(*ask, "_x", "_sigma", "_a", F.explode("_near").alias("_c")).select(*ask, F.col("_c._key").alias(key), d2.alias("_d2")).distinct()


def similar_cases(pop: DataFrame, targets: DataFrame, n: int = 5,
                  target_key: str = "target_id", key: str = KEY, numeric: str = NUMERIC_FEATURE) -> DataFrame:
    """For each target row (``target_key`` + the four features) the ``n`` nearest
    complete records, ranked by distance then key.  ``numeric`` is the numeric feature,
    discrete or continuous.  ``pop`` is read twice: for its features, and for the rows
    of the answers."""
    feats = [numeric, *CATEGORICAL_FEATURES]
    missing = [c for c in feats + [target_key] if c not in targets.columns]
    if missing:
        raise ValueError(f"the targets have no column for {missing}")
    complete = pop.na.drop(subset=feats)
    small = stored(complete.select(F.col(key).alias("_key"), F.col(numeric).cast("double").alias("_x"), *CATEGORICAL_FEATURES), "small")
    stats = F.broadcast(small.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v")))

    # The n lowest keys of every profile.
    low = Window.partitionBy("_x", *CATEGORICAL_FEATURES).orderBy("_key")
    few = small.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= n).drop("_r")

    t = targets.select(target_key, *[F.col(c).alias(f"t_{c}") for c in feats]).na.drop()
    ask = [f"t_{c}" for c in feats]
    ta = F.col(f"t_{numeric}").cast("double")
    var_t = ((F.col("_n") * F.col("_v") + F.col("_n") / (F.col("_n") + 1) * (ta - F.col("_m")) ** 2)
             / (F.col("_n") + 1))
    profiles = stored(t.select(*ask).distinct().crossJoin(stats).select(
        *ask, ta.alias("_x"), F.when(F.sqrt(var_t) > 0, F.sqrt(var_t)).otherwise(F.lit(1.0)).alias("_sigma")), "profiles")
    best = Window.partitionBy(*ask).orderBy("_d2", key)

    def nearest(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    answers, asking, full = None, profiles, len(CATEGORICAL_FEATURES)
    for missed in range(full + 1):
        # The places of the full set are the profiles themselves.
        found = _near(few if missed else small, asking, ask, [s for s in range(1 << full) if s.bit_count() == full - missed], n, key)
        found = found if answers is None else found.unionByName(answers).distinct()
        answers = stored(nearest(found).drop("rank"), "nearest")
        done = answers.groupBy(*ask).agg(F.count(F.lit(1)).alias("_m"), F.max("_d2").alias("_far")).where(
            (F.col("_m") == n) & (F.col("_far") < 2.0 * (missed + 1)))
        asking = profiles.join(done, ask, "left_anti")
        if asking.isEmpty():
            break
    answers = nearest(answers).join(complete, key)
    return t.join(answers, ask).select(target_key, "rank", F.bround(F.sqrt("_d2"), 6).alias("distance"),
                                       *[F.col(c) for c in pop.columns])
