"""The corpus pipeline: documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the
shared folder and reads it back as the next one's input.

ORACLE_SQL is None: the quality ratio and the token ids of the last stage cannot be
expressed in SQL; tests compare the stages with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import jaccard, line_dedup, mixing, packing, quality
from casebook.llm.queries import tokenizer_path
from casebook.llm.scratch import stored
from casebook.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.  The ratio is estimated on this
    stage's input; null texts have no words and go."""
    docs = docs.select(*COLUMNS)
    ratio = quality.fit_ratio(quality.with_trust(docs, read_table(spark, sf_dir, "labels")), F.col("trusted"))
    return quality.judge(docs, ratio).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts (n_chars follows); a text that loses all its
    words goes.  Texts without repeated lines stay as they are."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), threshold=2, min_chars=1, chars_per_edit=10)
    changed = F.size("removed_lines") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", "text", "lang", "source",
                      F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more)
    stays: the one with the smallest id, a null id after all others.  Rows are told
    apart by a stored number, for ids may be null or repeated."""
    docs = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered")
    found = jaccard.jaccard_components(docs, size=5, percent=80, key="_row")
    later = found.where("component_id <> _row").select("_row", F.col("component_id").alias("_group"))
    later = stored(later, "later")
    members = stored(later.unionByName(later.select(F.col("_group").alias("_row"), "_group").distinct()), "members")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    stays = (docs.select("doc_id", "_row").join(few(members), "_row").groupBy("_group")
             .agg(F.min(place).getField("_row").alias("_stays")))
    gone = stored(members.join(few(stored(stays, "stays")), "_group").where("_row <> _stays").select("_row"), "copies")
    return docs.join(few(gone), "_row", "left_anti").select(*COLUMNS)


def few(df: DataFrame) -> DataFrame:
    """A broadcast hint if the stored table is small enough; else as it is."""
    return F.broadcast(df) if df.count() <= jaccard.SMALL else df


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: every document at least once, those of
    small sources up to 1.5 times on the average of their source."""
    return mixing.mix(docs.select(*COLUMNS), repeat_limit=1.5).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece, with the token ids."""
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", jaccard_stage),
          ("source_mixing", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
