"""Intent classification and message routing.

Vectors come from a table (``embeddings``: array<float> + label) or, for raw
text, from hashed word and character n-grams computed by Spark ML feature
transformers; the classifier is a multinomial logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.quantiles import kept
from casebook.ml.features import split_flag
from casebook.session import stored


def train_vector_classifier(df: DataFrame, vec: str = "embedding", label: str = "label",
                            max_iter: int = 300) -> PipelineModel:
    """M11 on given vectors: logistic regression (multinomial, 300 iterations)."""
    d = df.select(array_to_vector(F.col(vec)).alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=max_iter, family="multinomial")
    return PipelineModel(stages=[lr.fit(d)])


def classify_vectors(model: PipelineModel, df: DataFrame, vec: str = "embedding") -> DataFrame:
    d = df.withColumn("features", array_to_vector(F.col(vec)))
    return model.transform(d).drop("features", "rawPrediction")


NGRAMS = (3,)  # lengths of the character n-grams


def hashed_ngrams(df: DataFrame, text: str = "text", out: str = "features", num_features: int = 1 << 14, grams=NGRAMS) -> DataFrame:
    """``df`` with sparse counts of the hashed words and character n-grams of the whole,
    lower-cased text in ``out`` (NULL: no entries).  Built-in expressions only."""
    clean = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    words = F.filter(F.split(clean, r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    def pieces(n: int) -> Column:
        """The overlapping n-grams, in one pass; a leading space tells them from words."""
        found = F.regexp_extract_all("_clean", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.concat(F.lit(" "), g))

    parts = [words, *map(pieces, grams)]
    return HashingTF(inputCol="_grams", outputCol=out, numFeatures=num_features).transform(
        df.withColumn("_clean", clean).withColumn("_grams", F.concat(*parts))).drop("_clean", "_grams")


def bounded(corpus: DataFrame, text: str, label: str, max_rows: int | None) -> DataFrame:
    """About ``max_rows`` of the labelled rows (None: all), those with the smallest text hash."""
    d = corpus.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    if max_rows is None:
        return d
    share = min(1.0, max_rows / max(1, d.count()))
    return d.where(F.pmod(F.xxhash64(text), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))


@dataclass
class TextIntents:
    """M11 on raw text: a multinomial model over hashed n-grams."""
    model: LogisticRegressionModel
    labels: list           # in label order
    num_features: int

    def save(self, path: str, spark) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.labels, self.num_features)], "labels array<string>, num_features int").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, path: str, spark) -> TextIntents:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(LogisticRegressionModel.load(f"{path}/model"), list(meta["labels"]), meta["num_features"])


def train_text_intents(corpus: DataFrame, text: str = "text", label: str = "intent", num_features: int = 1 << 14,
                       max_iter: int = 100, max_rows: int | None = None) -> TextIntents:
    """Labels in alphabetical order.  The fit uses every labelled row.  A caller may bound it to
    about ``max_rows`` of them; classification covers every row in any case."""
    d = stored(bounded(corpus, text, label, max_rows).select(text, label), "intents")
    labels = [r[0] for r in d.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
    if not labels:
        raise ValueError("the corpus has no labelled text")
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")) - 1
    rows = kept(hashed_ngrams(d.select(F.col(text).alias("text"), code.cast("double").alias("label")), "text", num_features=num_features)
                .select("features", "label"))
    # The fit makes a gradient per partition in every round: no more partitions than cores.
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    return TextIntents(LogisticRegression(maxIter=max_iter, family="multinomial", regParam=1e-4).fit(rows), labels, num_features)


def classify_texts(model: TextIntents, df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``predicted_intent``, for every row (a NULL text is an empty one)."""
    scored = model.model.transform(hashed_ngrams(df, text, "features", model.num_features))
    return scored.withColumn("predicted_intent", F.get(F.array(*[F.lit(x) for x in model.labels]), F.col("prediction").cast("int"))).drop(
        "features", "rawPrediction", "probability", "prediction")


# Canned replies per routed intent.
WELCOME = "Hello! How can I help you today?"
NOT_UNDERSTOOD = "Sorry, I didn't understand that request."


def route(intent_col: str = "predicted_intent"):
    """Hospital -> analyse with the tools; greeting -> welcome; else -> not understood."""
    i = F.col(intent_col)
    return (F.when(i == "hospital", F.lit("analyse"))
            .when(i == "greeting", F.lit("welcome")).otherwise(F.lit("not_understood")))


def with_routes(messages: DataFrame, intent: str = "predicted_intent") -> DataFrame:
    """Messages with an intent get their route and the canned reply (English;
    translation is not built)."""
    r = route(intent)
    reply = (F.when(r == "welcome", F.lit(WELCOME)).when(r == "not_understood", F.lit(NOT_UNDERSTOOD)))
    return messages.withColumn("route", r).withColumn("reply", reply)


def route_messages(model: TextIntents, messages: DataFrame, text: str = "text") -> DataFrame:
    """M12 over a message table: user turns only, classified, with route and reply."""
    users = messages.where(F.col("role") == "user") if "role" in messages.columns else messages
    return with_routes(classify_texts(model, users, text))


def split(df: DataFrame, key: str):
    f = split_flag(key)
    return df.where(f), df.where(~f)
