"""Batch scoring: readmission risk (M5), stay with range (M7), attributions
(M8 reports), risk-adjusted triage (T3), counterfactuals (M9 M10).

Every function scores a table in one pass (or one Arrow-batched task): no model call
per row.  A request that lacks an attribute cannot be scored; it is not lost but
listed by ``rejected_requests``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.stats import fixed_text
from casebook.ml import forest
from casebook.ml.features import CATEGORICAL
from casebook.operators.cohort import procedure_options
from casebook.schema import KEY


def _missing(bundle, df: DataFrame) -> Column:
    """The model's attributes that a row lacks."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in bundle.features]), lambda x: x.isNotNull())


def _check_columns(bundle, df: DataFrame) -> None:
    absent = [c for c in bundle.features if c not in df.columns]
    if absent:
        raise ValueError(f"the requests have no column for {absent}")


def _inputs(bundle, df: DataFrame) -> DataFrame:
    """The model's inputs beside the untouched request: ``_own`` holds the request's
    columns, ``_complete`` tells whether it has every attribute; a missing attribute
    becomes 0 or the empty string, whose score is not to be used."""
    _check_columns(bundle, df)
    feats = [(F.coalesce(F.col(c), F.lit("")) if c in CATEGORICAL
              else F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in bundle.features]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"),
                     (F.size(_missing(bundle, df)) == 0).alias("_complete"), *feats)


def _own(df: DataFrame) -> list[Column]:
    return [F.col(f"_own.`{f.name}`").alias(f.name) for f in df.schema["_own"].dataType.fields]


def rejected_requests(bundle, requests: DataFrame) -> DataFrame:
    """The requests that cannot be scored, with ``missing``: the attributes they lack."""
    _check_columns(bundle, requests)
    missing = _missing(bundle, requests)
    return requests.withColumn("missing", missing).where(F.size("missing") > 0)


def risk_scores(bundle, requests: DataFrame) -> DataFrame:
    """M5: P(readmission) per complete request (rounded to 4), predicted class, and
    the percentage text, beside the request's own columns; for the others see
    ``rejected_requests``."""
    p = bundle.scored(_inputs(bundle, requests).where("_complete"))
    return p.select(*_own(p),
                    F.when(F.col("_prediction") == 1.0, "Yes").otherwise("No").alias("predicted_readmission"),
                    F.bround("_p", 4).alias("probability_of_readmission"),
                    F.concat(F.format_number(F.bround(F.col("_p") * 100, 1), 1), F.lit("%"))
                    .alias("probability_of_readmission_pct"))


def los_scores(bundle, requests: DataFrame, keys, population_mean: float | None = None,
               population_std: float | None = None, z: float = 1.645) -> DataFrame:
    """M7: predicted stay (1 dec), a 90% range from the spread of the trees (lower
    bounded by 1), above/below the population mean, and the model's version, training
    size and test error.  ``keys`` are columns of the requests."""
    spark = requests.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    r = _inputs(bundle, requests).where("_complete")
    r = r.select("*", *[F.col(f"_own.`{k}`").alias(k) for k in keys if k not in bundle.features])
    st = forest.per_tree_stats(bundle, r, keys, spark)
    meta = bundle.meta
    mean = population_mean if population_mean is not None else meta.get("target_mean", 0.0)
    std = population_std if population_std is not None else meta.get("target_std", 0.0)
    p, s = F.col("forest_mean"), F.col("tree_std")
    return st.select(*keys,
                     F.bround(p, 1).alias("predicted_length_of_stay_days"),
                     F.bround(F.greatest(F.lit(1.0), p - z * s), 1).alias("lower_bound_days"),
                     F.bround(p + z * s, 1).alias("upper_bound_days"),
                     F.bround(F.lit(float(mean)), 1).alias("population_mean_days"),
                     F.bround(F.lit(float(std or 0.0)), 1).alias("population_std_days"),
                     F.when(p > F.lit(float(mean)), "above_average").otherwise("below_average").alias("vs_population"),
                     F.lit(meta.get("model_version")).alias("model_version"),
                     F.lit(meta.get("trained_on_n")).cast("long").alias("trained_on_n"),
                     F.bround(F.lit(meta.get("test_mae")).cast("double"), 2).alias("test_mae"))


def attribution_report(bundle, requests: DataFrame, keys, top: int = 5) -> DataFrame:
    """M8 report: per complete request the ``top`` features by |Shapley value|, with
    the input value, direction, rounded to 4, and the base value.  Requests that share
    their keys are ranked together.

    The requests are brought together by key before they become a row per feature: one
    whose key is its own is ranked within its row, only the others are shuffled again."""
    spark = requests.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    _check_columns(bundle, requests)
    asked = requests.where(F.size(_missing(bundle, requests)) == 0).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *bundle.features])])
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.repartition(parts, *keys).withColumn("_alike", F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    def explained(some: DataFrame, even: bool) -> tuple[DataFrame, float]:
        r = _inputs(bundle, some)
        r = r.select("*", *[F.col(f"_own.`{k}`").alias(k) for k in keys if k not in bundle.features])
        return forest.shapley_rows(bundle, r, keys, spark, even=even)

    up, down = (("increases_risk", "decreases_risk") if bundle.kind == "risk"
                else ("increases_los", "decreases_los"))
    # Rounded before ranking and before the final rounding of halves: the last digits depend on the order of summation.
    rounded = F.transform(forest.paid(bundle.features), lambda a: F.struct(
        (-F.abs(F.bround(a["shap_value"], 9))).alias("order"), a["feature"].alias("feature"), a["value"].alias("value"),
        F.bround(a["shap_value"], 9).alias("shap_value")))
    rows, base = explained(asked.where(F.col("_alike") == 1), True)
    alone = rows.select(*keys, F.posexplode(F.slice(F.array_sort(rounded), 1, top)).alias("_at", "_a")).select(
        *keys, (F.col("_at") + 1).alias("rank"), "_a.*")
    rows, _ = explained(asked.where(F.col("_alike") > 1), False)
    w = Window.partitionBy(*keys).orderBy("order", "feature")
    shared = (rows.select(*keys, F.explode(rounded).alias("_a")).select(*keys, "_a.*")
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
    return alone.unionByName(shared).select(
        *keys, "rank", "feature", "value", F.bround("shap_value", 4).alias("shap_value"),
        F.when(F.col("shap_value") > 0, up).otherwise(down).alias("direction"),
        F.bround(F.abs("shap_value"), 4).alias("abs_importance"),
        F.bround(F.lit(base), 4).alias("base_value"))


# The reason added to a flagged row, around the percentage.
HIGH_RISK = ("High readmission risk (", "%)")


def triage_with_risk(bundle, flagged: DataFrame, limit: int = 20, key: str = KEY) -> DataFrame:
    """Score every flagged row once; a probability above 0.5 adds 2.0 and a
    reason; then the top ``limit`` by score (ties by key).  A row the model cannot
    score keeps its rule score, with a NULL probability."""
    p = bundle.scored(_inputs(bundle, flagged))
    prob = F.when(F.col("_complete"), F.bround("_p", 4))
    s = p.select(*_own(p), prob.alias("readmission_probability"))
    high = F.coalesce(F.col("readmission_probability") > 0.5, F.lit(False))
    reason = F.concat(F.lit(HIGH_RISK[0]), F.bround(F.col("readmission_probability") * 100, 0).cast("int").cast("string"), F.lit(HIGH_RISK[1]))
    return (s.withColumn("score", F.when(high, F.col("score") + 2.0).otherwise(F.col("score")))
            .withColumn("reasons", F.when(high, F.concat("reasons", F.array(reason))).otherwise(F.col("reasons")))
            .orderBy(F.desc("score"), F.asc(key)).limit(limit))


LOS_DELTAS = (-3, -2, -1, 1, 2, 3)
# Order of the kinds of change among equal reductions.
CHANGE_TYPES = ("length_of_stay", "procedure", "combined")
REQUEST = ("Age", "Gender", "Condition", "Procedure", "Length_of_Stay")


def _with_candidates(cases: DataFrame, requests: DataFrame, keys: list, los_min: int, los_max: int,
                     combined_los: int, with_current: bool) -> DataFrame:
    """Requests (``keys`` and their attributes) with ``_c``, an array of (type_order, option_order, Procedure,
    Length_of_Stay); type 0 is the request itself.

    The procedure options of a condition are one array (its procedures that were seen
    often enough), joined once.
    """
    options = (procedure_options(cases)
               .groupBy(F.col("condition_key").alias("_condition"))
               .agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("r"), F.col("Procedure").alias("p")))).alias("_options")))
    req = requests.select(*keys, *REQUEST).join(options, F.lower(F.col("Condition")) == F.col("_condition"), "left")

    def change(kind: int, order: Column, procedure: Column, stay: Column) -> Column:
        return F.struct(F.lit(kind).alias("type_order"), order.cast("int").alias("option_order"),
                        procedure.alias("Procedure"), stay.cast("int").alias("Length_of_Stay"))

    own, stay = F.col("Procedure"), F.col("Length_of_Stay")
    stays = F.filter(F.array(*[F.struct(F.lit(i + 1).alias("o"), (stay + d).alias("s")) for i, d in enumerate(LOS_DELTAS)]),
                     lambda x: F.coalesce((x["s"] >= los_min) & (x["s"] <= los_max), F.lit(False)))
    others = F.filter(F.coalesce("_options", F.array().cast("array<struct<r:int,p:string>>")),
                      lambda x: F.coalesce(x["p"] != own, F.lit(False)))
    req = req.withColumn("_stays", stays).withColumn("_others", others)
    best = F.get("_others", 0)["p"]
    parts = [F.transform("_stays", lambda x: change(1, x["o"], own, x["s"])),
             F.transform("_others", lambda x: change(2, x["r"], x["p"], stay)),
             F.when(best.isNull(), F.array()).otherwise(
                 F.transform(F.slice("_stays", 1, combined_los), lambda x: change(3, x["o"], best, x["s"])))]
    if with_current:
        parts.insert(0, F.array(change(0, F.lit(0), own, stay)))
    return req.select(*keys, *REQUEST, F.concat(*parts).alias("_c"))


def counterfactual_candidates(cases: DataFrame, requests: DataFrame, key: str = "request_id",
                              los_min: int = 1, los_max: int = 30, combined_los: int = 3) -> DataFrame:
    """M9: candidate changes per request: stay +-1..3 within bounds, each other
    procedure used for the condition (seen >= 5 times, by readmission rate), and
    the best other procedure with the first three stay candidates."""
    c = _with_candidates(cases, requests, [key], los_min, los_max, combined_los, False)
    c = c.select(key, "Age", "Gender", "Condition", F.explode("_c").alias("_c"))
    kind = F.get(F.array(*[F.lit(t) for t in CHANGE_TYPES]), F.col("_c.type_order") - 1)
    return c.select(key, kind.alias("change_type"), "Age", "Gender", "Condition",
                    F.col("_c.Procedure").alias("Procedure"), F.col("_c.Length_of_Stay").alias("Length_of_Stay"),
                    F.col("_c.type_order").alias("type_order"), F.col("_c.option_order").alias("option_order"))


def scored_once(bundle, df: DataFrame) -> DataFrame:
    """``df`` with ``_new``: the model's probability for each row, rounded to 4; NULL where
    an attribute is missing.  Each distinct tuple of attributes is scored once and the
    answers are joined back, so the forest sees as many rows as there are tuples."""
    tuples = df.select(*bundle.features).na.drop().distinct()
    answers = bundle.scored(tuples.select("*", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(bundle.features)])
                            .withColumns({c: F.col(c).cast("double") for c in bundle.features if c not in CATEGORICAL}))
    answers = answers.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(bundle.features)], F.bround("_p", 4).alias("_new"))
    return df.join(answers, list(bundle.features), "left")


FROM = [f"_from_{c}" for c in REQUEST]


def _ranked_changes(bundle, cases: DataFrame, requests: DataFrame, target: float) -> DataFrame:
    """Per distinct tuple of request attributes (columns ``FROM``): the request itself
    (type 0) and its changes with ``new``, ``current``, ``kept`` (the change helps) and,
    for those, ``rank``.  The answer depends on nothing else of a request."""
    if not 0 < target < 1:
        raise ValueError("the target must lie between 0 and 1")
    c = _with_candidates(cases, requests.select(*REQUEST).distinct(), [], 1, 30, 3, True)
    c = c.select("Age", "Gender", "Condition", *[F.col(x).alias(f) for x, f in zip(REQUEST, FROM)], F.explode("_c").alias("_c"))
    c = c.select("Age", "Gender", "Condition", *FROM, F.col("_c.Procedure").alias("Procedure"), F.col("_c.Length_of_Stay").alias("Length_of_Stay"),
                 F.col("_c.type_order").alias("type_order"), F.col("_c.option_order").alias("option_order"))
    s = scored_once(bundle, c).withColumnRenamed("_new", "new")
    mine = Window.partitionBy(*FROM)
    s = s.withColumn("current", F.max(F.when(F.col("type_order") == 0, F.col("new"))).over(mine))
    helps = F.when(F.col("type_order") == 3, F.col("new") < F.col("current") * 0.9).otherwise(F.col("new") < F.col("current"))
    kept = (F.col("type_order") > 0) & (F.col("current") > target) & helps
    best = mine.orderBy(F.desc("kept"), F.desc(F.bround(F.col("current") - F.col("new"), 4)), "type_order", "option_order")
    return (s.withColumn("kept", F.coalesce(kept, F.lit(False)))
            .withColumn("rank", F.when(F.col("kept"), F.row_number().over(best))))


def _for_requests(requests: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """Each request's key with the answers of its attributes (NULLs equal NULLs)."""
    asked = requests.select(key, *REQUEST)
    same = [asked[x].eqNullSafe(answers[f]) for x, f in zip(REQUEST, FROM)]
    return asked.join(answers, same).drop(*REQUEST)


def counterfactuals(bundle, cases: DataFrame, requests: DataFrame,
                    target_probability: float = 0.20, key: str = "request_id", top: int = 10) -> DataFrame:
    """For each request above the target, the changes that lower the predicted
    risk (combined changes: by at least 10%), best first, top 10, with what changes
    from and to.  Requests without such a change: see ``counterfactual_summary``."""
    s = _ranked_changes(bundle, cases, requests, target_probability).where(F.col("rank") <= top)
    up = F.col("Length_of_Stay") - F.col("_from_Length_of_Stay")
    text = (F.when(F.col("type_order") == 1, F.concat(F.when(up > 0, "longer").otherwise("shorter"), F.lit(" stay by "),
                                                      F.abs(up).cast("string"), F.lit(" days")))
            .when(F.col("type_order") == 2, F.concat(F.lit("procedure "), F.col("Procedure")))
            .otherwise(F.concat(F.lit("stay of "), F.col("Length_of_Stay").cast("string"), F.lit(" days, procedure "),
                                F.col("Procedure"))))
    kind = F.get(F.array(*[F.lit(t) for t in CHANGE_TYPES]), F.col("type_order") - 1)
    answers = s.select(
        *FROM, "rank", kind.alias("change_type"), F.col("_from_Procedure").alias("from_procedure"), F.col("Procedure").alias("to_procedure"),
        F.col("_from_Length_of_Stay").alias("from_length_of_stay"), F.col("Length_of_Stay").alias("to_length_of_stay"), text.alias("description"),
        F.col("current").alias("current_probability"), F.col("new").alias("estimated_probability"),
        F.bround(F.col("current") - F.col("new"), 4).alias("probability_reduction"), (F.col("new") <= target_probability).alias("meets_target"))
    out = _for_requests(requests, key, answers).drop(*FROM)
    return out.withColumnsRenamed({"to_procedure": "Procedure", "to_length_of_stay": "Length_of_Stay"})


def counterfactual_summary(bundle, cases: DataFrame, requests: DataFrame, target_probability: float = 0.20,
                           key: str = "request_id", top: int = 10, texts: bool = False) -> DataFrame:
    """One answer per request (``texts`` adds the probabilities as percentages): its current probability (NULL and ``scored``
    false if it lacks an attribute), whether it is at the target already, the number
    of options that help, of suggestions kept, and whether a suggestion meets the
    target."""
    s = _ranked_changes(bundle, cases, requests, target_probability)
    shown = F.coalesce(F.col("rank") <= top, F.lit(False))
    answers = s.groupBy(*FROM).agg(
        F.max("current").alias("current_probability"),
        F.max(F.col("current").isNotNull()).alias("scored"),
        F.max(F.coalesce(F.col("current") <= target_probability, F.lit(False))).alias("already_at_target"),
        F.sum(F.col("kept").cast("long")).alias("total_options_explored"),
        F.sum(shown.cast("long")).alias("suggestions"),
        F.max(shown & F.coalesce(F.col("new") <= target_probability, F.lit(False))).alias("target_achievable"))
    if texts:
        answers = answers.withColumns({
            "current_probability_pct": fixed_text(F.col("current_probability") * 100, 1, after="%"),
            "target_probability_pct": fixed_text(F.lit(target_probability * 100), 1, after="%")})
    return _for_requests(requests, key, answers).drop(*FROM)
