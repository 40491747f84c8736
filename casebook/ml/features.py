"""Feature preparation: label encoding (M1) and the deterministic split (M2)."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.quantiles import kept
from casebook.schema import KEY
from casebook.session import stored

# Categorical model inputs.
CATEGORICAL = ("Gender", "Condition", "Procedure")
RISK_FEATURES = ("Age", "Gender", "Condition", "Procedure", "Length_of_Stay")
LOS_FEATURES = ("Age", "Gender", "Condition", "Procedure", "Cost")


def code_col(c: str) -> str:
    return f"{c}_code"


def fit_label_encoder(df: DataFrame, cols=CATEGORICAL) -> StringIndexerModel:
    """M1: alphabetical codes 0..n-1 per column (as a label encoder gives)."""
    cols = list(cols)
    return StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols],
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)


def unseen_to_zero(model: StringIndexerModel, cols=CATEGORICAL) -> SQLTransformer:
    """Map the "unseen" index (n) to code 0, the alphabetically first class.  The indexer's
    column metadata ends here; training names the labels again."""
    cols = list(cols)
    parts = []
    for c, labels in zip(cols, model.labelsArray):
        n = len(labels)
        parts.append(f"CAST(CASE WHEN `{c}_idx` >= {n} THEN 0 ELSE `{c}_idx` END AS double) AS `{code_col(c)}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def label_codes(model: StringIndexerModel, spark, cols=CATEGORICAL) -> DataFrame:
    """The code table: (column, value, code); model-sized."""
    rows = [(c, v, i) for c, labels in zip(cols, model.labelsArray) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "`column` string, value string, code int")


HASH_RANGE = 1 << 32


def key_hash(key: str = KEY, salt: str = "") -> Column:
    """The first 8 hex digits of the key's MD5 as a number below 2^32: a hash that
    other engines share, stable across partitioning and recomputation."""
    text = F.concat(F.lit(salt), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def split_flag(key: str = KEY, train_pct: int = 80) -> Column:
    """M2 for a numeric target: true for the lower ``train_pct`` per cent of the hash range."""
    return key_hash(key) < F.lit(HASH_RANGE * train_pct // 100)


def stratified_split(df: DataFrame, label: str, key: str = KEY, train_pct: int = 80) -> DataFrame:
    """M2 for a class label: ``df`` plus ``_train``, true for ``train_pct`` per cent
    (rounded) of every label's rows, those with the smallest key hash.

    Each label's threshold is the hash at that rank, found from counts in two steps
    of 16 bits; a window holds at most 65,536 counts.  Rows with equal hashes fall on
    the same side.  ``df`` is computed once, into the shared folder: it is read for the
    counts and by every reader of the result.
    """
    df = stored(df, "split")
    h = df.select(F.col(label).alias("_label"), key_hash(key).alias("_hash"))
    upper, lower = F.shiftright("_hash", 16), F.col("_hash").bitwiseAND(F.lit(0xFFFF))
    counts = h.groupBy("_label", upper.alias("_u")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("_label").orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (counts.withColumn("_upto", F.sum("c").over(upto)).withColumn("_n", F.sum("c").over(Window.partitionBy("_label")))
              .withColumn("_want", F.greatest(F.lit(1), F.round(F.col("_n") * train_pct / 100).cast("long"))))
    edge = counts.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("c") < F.col("_want"))).select(
        "_label", "_u", (F.col("_want") - F.col("_upto") + F.col("c")).alias("_left"))
    inner = (h.join(F.broadcast(edge), "_label").where(upper == F.col("_u"))
             .groupBy("_label", "_u", "_left", lower.alias("_l")).agg(F.count(F.lit(1)).alias("c")))
    reached = Window.partitionBy("_label").orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = kept(inner.withColumn("_upto", F.sum("c").over(reached)).where(F.col("_upto") >= F.col("_left"))
                .groupBy("_label").agg(F.min(F.col("_u") * 65536 + F.col("_l")).alias("_last")))
    # One row a label: class labels are few by nature.
    out = df.join(F.broadcast(last), df[label] == F.col("_label"), "left")
    return out.withColumn("_train", key_hash(key) <= F.col("_last")).drop("_label", "_last")
