"""Readmission classifier and length-of-stay regressor.

A trained model is a ``ModelBundle``: a Spark ``PipelineModel`` (encoders ->
code fix-up -> assembler -> forest) plus a one-row metadata table.  Fits of more than
``PART_ROWS`` rows are made by ``grow``, smaller ones by Spark ML's trainers.  A forest that
may have more than ``PART_NODES`` nodes is saved in parts of some trees each; it is
applied as flat arrays, so neither the driver nor an executor holds all its trees as
objects.  Training data stays distributed; only model-sized objects reach the driver.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.ml import forest, grow
from casebook.ml.features import (CATEGORICAL, LOS_FEATURES, RISK_FEATURES, code_col,
                                  HASH_RANGE, fit_label_encoder, key_hash, split_flag,
                                  stratified_split, unseen_to_zero)
from casebook.schema import KEY, LOS, READMISSION
from casebook.session import checkpoint_dir, stored


@dataclass
class ModelBundle:
    kind: str                      # "risk" | "los"
    pipeline: PipelineModel
    features: list                 # raw feature names, in model order
    meta: dict = field(default_factory=dict)
    _flat: forest.FlatForest | None = None
    parts: list = field(default_factory=list)  # folders of the parts of a forest that is no stage of the pipeline

    @property
    def forest(self):
        if self.parts:
            raise ValueError("the forest is in parts: see ``parts`` and ``flat``")
        return self.pipeline.stages[-1]

    @property
    def encoder(self):
        return self.pipeline.stages[0]

    def model_columns(self) -> list[str]:
        return [code_col(c) if c in CATEGORICAL else c for c in self.features]

    def numeric_inputs(self, df: DataFrame) -> DataFrame:
        """``df`` with the code columns of its categorical features."""
        return self.pipeline.stages[1].transform(self.encoder.transform(df))

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_prediction`` and, for a classifier, ``_p`` = P(Yes)."""
        if self.parts:
            x, spark = self.numeric_inputs(df), df.sparkSession
            mean = forest.mean_values(self.flat(spark), [F.col(c) for c in self.model_columns()], spark)
            if self.kind == "risk":
                return forest.spread(x).withColumn("_p", mean).withColumn("_prediction", F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0))
            return forest.spread(x).withColumn("_prediction", mean)
        out = self.pipeline.transform(df).withColumnRenamed("prediction", "_prediction")
        return out.withColumn("_p", vector_to_array("probability")[1]) if self.kind == "risk" else out

    def flat(self, spark: SparkSession) -> forest.FlatForest:
        """The trees as flat arrays, read back from the model once."""
        if self._flat is None and self.parts:
            self._flat = forest.joined([forest.read_forest(p, spark, len(self.features), self.kind == "risk") for p in self.parts])
        elif self._flat is None:
            self._flat = forest.flatten_forest(self.forest, spark)
        return self._flat


# Tree training knobs that change only how nodes are batched per pass over the
# data, not the splits: node ids cached (and checkpointed to the shared checkpoint
# folder) instead of re-walking the trees, and the statistics of a pass bounded.  Every
# running task holds that much, so several to an executor must fit beside each other.
TRAIN_OPTS = {"maxMemoryInMB": 128, "cacheNodeIds": True, "checkpointInterval": 10}
FIT_ROWS = 16_000  # about the rows of a partition of the fit, at least; fewer are one partition
PART_NODES = 1 << 20  # nodes that the trees fitted together may have at most, if more than one tree
PART_ROWS = 50_000  # fits of at most so many rows are one model: their trees have few nodes


def _nominal(features, encoder, max_bins: int) -> dict:
    """Column metadata of the feature vector: the categorical inputs with their labels, so
    that trees split them by sets.  One with more than ``max_bins`` labels stays ordered."""
    labels = dict(zip(CATEGORICAL, encoder.labelsArray))
    numeric, nominal = [], []
    for i, c in enumerate(features):
        if c in CATEGORICAL and 0 < len(labels[c]) <= max_bins:
            nominal.append({"idx": i, "name": code_col(c), "vals": list(labels[c])})
        else:
            numeric.append({"idx": i, "name": c})
    attrs = {k: v for k, v in (("numeric", numeric), ("nominal", nominal)) if v}
    return {"ml_attr": {"attrs": attrs, "num_attrs": len(features)}}


def _part_sizes(trainer, fitted: int) -> list[int]:
    """The numbers of trees that are fitted together: all of them, unless trees of that depth
    may have more than ``PART_NODES`` nodes and more than ``PART_ROWS`` rows are fitted."""
    trees = trainer.getNumTrees()
    most = max(1, PART_NODES >> (trainer.getMaxDepth() + 1))
    if fitted <= PART_ROWS or trees <= most:
        return [trees]
    parts = -(-trees // most)
    return [trees * (i + 1) // parts - trees * i // parts for i in range(parts)]


def _pipeline(rows: DataFrame, train: DataFrame, features, trainer, nominal: bool, key: str) -> tuple[PipelineModel, list, int]:
    """The pipeline, the folders of the forest's parts (none: it is the last stage) and the
    number of rows of the fit."""
    # Codes come from every cleaned row (as the reference encodes before the
    # split); the forest sees only the training split.
    enc = fit_label_encoder(rows)
    fix = unseen_to_zero(enc)
    cols = [code_col(c) if c in CATEGORICAL else c for c in features]
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    train, fitted = _fit_rows(train, features, key)
    coded = fix.transform(enc.transform(train))
    sets = _nominal(features, enc, trainer.getMaxBins() if nominal else 0)
    if fitted <= PART_ROWS:
        prepared = asm.transform(coded)
        if nominal:
            prepared = prepared.withMetadata("features", sets)
        return PipelineModel(stages=[enc, fix, asm, trainer.fit(prepared)]), [], fitted
    parts = _grown(coded, cols, sets, trainer, fitted)
    if len(parts) > 1:
        return PipelineModel(stages=[enc, fix, asm]), parts, fitted
    model = _part_model("risk" if isinstance(trainer, RandomForestClassifier) else "los", parts[0])
    return PipelineModel(stages=[enc, fix, asm, model]), [], fitted


def _grown(coded: DataFrame, cols: list, sets: dict, trainer, fitted: int) -> list[str]:
    """The folders of the parts of a forest that ``grow`` makes with the trainer's parameters,
    saved as Spark ML saves its models."""
    spark, m = coded.sparkSession, len(cols)
    arity = {a["idx"]: len(a["vals"]) for a in sets["ml_attr"]["attrs"].get("nominal", [])}
    classes = isinstance(trainer, RandomForestClassifier)
    tried = {"all": m, "sqrt": math.ceil(math.sqrt(m))}[trainer.getFeatureSubsetStrategy()]
    rules = grow.Rules([[] if j in arity else grow.thresholds(coded, c, trainer.getMaxBins()) for j, c in enumerate(cols)],
                       [arity.get(j, -1) for j in range(m)], tried, trainer.getMaxDepth(), trainer.getMinInstancesPerNode(), trainer.getSeed(), classes)
    dealt = min(-(-fitted // FIT_ROWS), max(spark.sparkContext.defaultParallelism, -(-fitted // grow.FILE_ROWS)))
    nodes = stored(grow.grow(grow.binned(coded, cols, rules, dealt), trainer.getNumTrees(), rules), "trees")
    split = F.struct("featureIndex", F.col("split").alias("leftCategoriesOrThreshold"), "numCategories").alias("split")
    saved = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split).alias("nodeData")
    # Everything but the nodes is that of a model of as many trees on two rows.
    two = spark.createDataFrame([(Vectors.dense([float(i)] * m), float(i)) for i in range(2)], ["features", "label"])
    folder, at, parts = f"{checkpoint_dir(spark).rstrip('/')}/casebook-forest/{uuid.uuid4().hex}", 0, []
    for i, trees in enumerate(_part_sizes(trainer, fitted)):
        parts.append(f"{folder}/{i}")
        trainer.copy({trainer.numTrees: trees}).fit(two).write().save(parts[-1])
        mine = nodes.where(F.col("treeID").between(at, at + trees - 1)).withColumn("treeID", F.col("treeID") - at)
        mine.select("treeID", saved).write.mode("overwrite").parquet(f"{parts[-1]}/data")
        at += trees
    return parts


def _cast_features(df: DataFrame, features) -> DataFrame:
    out = df
    for c in features:
        if c not in CATEGORICAL:
            out = out.withColumn(c, F.col(c).cast("double"))
    return out


def _bounded_fit(train: DataFrame, max_rows: int | None, key: str) -> DataFrame:
    """About ``max_rows`` of the training rows, those with the smallest hash (the
    hash is uniform: a share of its range is that share of the rows)."""
    if max_rows is None:
        return train
    share = min(1.0, max_rows / max(1, train.count()))
    return train.where(key_hash(key, salt="fit") < F.lit(int(share * HASH_RANGE)))


def _fit_rows(train: DataFrame, features, key: str) -> tuple[DataFrame, int]:
    """The rows of the fit, computed once, and their number.  Every pass of Spark ML's trainers
    makes the statistics of its nodes once per partition, however few rows that has: so there
    are at most as many partitions as cores, and none for fewer than ``FIT_ROWS`` rows."""
    rows = stored(train.select(key, *features, "label"), "fit")
    n = rows.count()
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FIT_ROWS))
    if parts <= 1 or n > PART_ROWS:
        return rows.coalesce(max(1, parts)), n
    return rows.repartition(parts, key, *features).sortWithinPartitions(key, *features), n


def train_risk_model(cases: DataFrame, num_trees: int = 100, max_depth: int = 10,
                     seed: int = 42, key: str = KEY, max_bins: int = 256,
                     max_rows: int | None = None, nominal: bool = True) -> ModelBundle:
    """M3: random forest for P(Readmission = Yes) on Age, Gender, Condition,
    Procedure, Length_of_Stay; rows with a NULL feature or label are dropped.
    ``max_bins`` bounds the split candidates of a feature.  Categories are split by sets
    of labels; with ``nominal`` off, or above ``max_bins`` labels, by the order of their
    codes.  The fit uses every training row.  A caller may bound it to about ``max_rows`` of
    them, those with the smallest key hash; encoding, scoring and every metric cover all
    rows in any case."""
    feats = list(RISK_FEATURES)
    d = _cast_features(cases.na.drop(subset=feats + [READMISSION]), feats).withColumn(
        "label", F.when(F.col(READMISSION) == "Yes", 1.0).otherwise(0.0))
    d = stratified_split(d.select(key, *feats, "label"), "label", key)
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt",
                                seed=seed, maxBins=max_bins, **TRAIN_OPTS)
    pipe, parts, fitted = _pipeline(d, _bounded_fit(d.where("_train"), max_rows, key), feats, rf, nominal, key)
    return ModelBundle("risk", pipe, feats, {"model_version": "spark-rf-1", "seed": seed, "fitted_on_n": fitted,
                                             "num_trees": num_trees, "max_depth": max_depth}, parts=parts)


def train_los_model(cases: DataFrame, num_trees: int = 100, max_depth: int = 15,
                    seed: int = 42, key: str = KEY, max_bins: int = 256,
                    max_rows: int | None = None, nominal: bool = True) -> ModelBundle:
    """M6: random forest regressor for Length_of_Stay on Age, Gender, Condition,
    Procedure, Cost.

    The fit uses every training row.  A caller may bound it to about ``max_rows`` of
    them, those with the smallest key hash; encoding, scoring and every metric cover
    all rows in any case.
    """
    feats = list(LOS_FEATURES)
    d = _cast_features(cases.na.drop(subset=feats + [LOS]), feats).withColumn(
        "label", F.col(LOS).cast("double"))
    d = stored(d.select(key, *feats, "label"), "split").withColumn("_train", split_flag(key))
    rf = RandomForestRegressor(labelCol="label", featuresCol="features", numTrees=num_trees,
                               maxDepth=max_depth, minInstancesPerNode=2, featureSubsetStrategy="all",
                               seed=seed, maxBins=max_bins, **TRAIN_OPTS)
    pipe, parts, fitted = _pipeline(d, _bounded_fit(d.where("_train"), max_rows, key), feats, rf, nominal, key)
    return ModelBundle("los", pipe, feats, {"model_version": "spark-rf-1", "seed": seed, "fitted_on_n": fitted,
                                            "num_trees": num_trees, "max_depth": max_depth}, parts=parts)


def labelled(bundle: ModelBundle, cases: DataFrame, key: str = KEY) -> DataFrame:
    """The model's own cleaned, labelled rows with the split flag."""
    feats = bundle.features
    target = READMISSION if bundle.kind == "risk" else LOS
    d = _cast_features(cases.na.drop(subset=feats + [target]), feats)
    lab = (F.when(F.col(READMISSION) == "Yes", 1.0).otherwise(0.0) if bundle.kind == "risk"
           else F.col(LOS).cast("double"))
    d = d.withColumn("label", lab)
    return stratified_split(d, "label", key) if bundle.kind == "risk" else stored(d, "split").withColumn("_train", split_flag(key))


def classifier_report(bundle: ModelBundle, cases: DataFrame) -> DataFrame:
    """M4: per split and class: support, precision, recall, F1, plus accuracy,
    from confusion counts (one aggregate over the distinct scored rows)."""
    return _classifier_report(bundle, labelled(bundle, cases))


def _classifier_report(bundle: ModelBundle, rows: DataFrame) -> DataFrame:
    # Equal rows get equal predictions: each distinct one is scored once, with its count.
    alike = rows.groupBy(*bundle.features, "label", "_train").agg(F.count(F.lit(1)).alias("_n"))
    p = bundle.scored(alike).withColumnRenamed("_prediction", "prediction")
    split = F.when(F.col("_train"), "train").otherwise("test")
    conf = p.groupBy(split.alias("split")).agg(
        *[F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("_n"))), F.lit(0)).alias(f"c{int(a)}{int(b)}")
          for a in (0.0, 1.0) for b in (0.0, 1.0)])
    parts = []
    for cls, name in ((1, "Yes"), (0, "No")):
        other = 1 - cls
        tp, fp, fn = f"c{cls}{cls}", f"c{other}{cls}", f"c{cls}{other}"
        prec = F.try_divide(F.col(tp), F.col(tp) + F.col(fp))
        rec = F.try_divide(F.col(tp), F.col(tp) + F.col(fn))
        parts.append(conf.select(
            "split", F.lit(name).alias("class"), (F.col(tp) + F.col(fn)).alias("support"),
            F.bround(prec, 4).alias("precision"), F.bround(rec, 4).alias("recall"),
            F.bround(F.try_divide(2 * prec * rec, prec + rec), 4).alias("f1"),
            ((F.col("c00") + F.col("c11")) / (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")))
            .alias("accuracy")))
    return parts[0].unionByName(parts[1])


def regression_report(bundle: ModelBundle, cases: DataFrame) -> DataFrame:
    """M6 metrics per split: MAE, RMSE, R^2 as aggregates."""
    return _regression_report(bundle, labelled(bundle, cases))


def _regression_report(bundle: ModelBundle, rows: DataFrame) -> DataFrame:
    p = bundle.scored(rows).withColumnRenamed("_prediction", "prediction")
    split = F.when(F.col("_train"), "train").otherwise("test")
    err = F.col("prediction") - F.col("label")
    g = p.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"), (F.var_pop("label") * F.count(F.lit(1))).alias("_sst"))
    return g.select("split", "n", "mae", "rmse", (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def feature_importances(bundle: ModelBundle, spark: SparkSession) -> DataFrame:
    """Importances zipped with feature names (model-sized)."""
    models = [_part_model(bundle.kind, p) for p in bundle.parts] or [bundle.forest]
    trees = sum(m.getNumTrees for m in models)
    imp = sum(m.featureImportances.toArray() * (m.getNumTrees / trees) for m in models).tolist()
    return spark.createDataFrame(list(zip(bundle.features, [float(x) for x in imp])),
                                 "feature string, importance double")


def _part_model(kind: str, path: str):
    return (RandomForestClassificationModel if kind == "risk" else RandomForestRegressionModel).load(path)


def save_bundle(bundle: ModelBundle, path: str, spark: SparkSession, extra_meta: dict | None = None) -> None:
    """Pipeline via Spark ML persistence; metadata as a one-row parquet."""
    bundle.pipeline.write().overwrite().save(f"{path}/pipeline")
    for i, part in enumerate(bundle.parts):
        for table in ("data", "treesMetadata"):
            spark.read.parquet(f"{part}/{table}").write.mode("overwrite").parquet(f"{path}/forest/{i}/{table}")
        spark.read.text(f"{part}/metadata").coalesce(1).write.mode("overwrite").text(f"{path}/forest/{i}/metadata")
    meta = dict(bundle.meta, **(extra_meta or {}), kind=bundle.kind, features=bundle.features, parts=len(bundle.parts))
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load_bundle(path: str, spark: SparkSession) -> ModelBundle:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    parts = [f"{path}/forest/{i}" for i in range(meta.get("parts", 0))]
    return ModelBundle(meta["kind"], PipelineModel.load(f"{path}/pipeline"), meta["features"], meta, parts=parts)


def model_info(path: str, spark: SparkSession) -> DataFrame:
    """Version, training size (labelled rows of both splits; rows the forest was
    fitted on), features and rounded metrics from the metadata table (no model
    evaluation)."""
    m = spark.read.parquet(f"{path}/meta")
    j = F.col("meta")
    return m.select(
        F.get_json_object(j, "$.kind").alias("kind"),
        F.get_json_object(j, "$.model_version").alias("version"),
        F.get_json_object(j, "$.trained_on_n").cast("long").alias("trained_on_n"),
        F.get_json_object(j, "$.fitted_on_n").cast("long").alias("fitted_on_n"),
        F.get_json_object(j, "$.features").alias("features"),
        F.get_json_object(j, "$.target_distribution.Yes").cast("long").alias("readmission_yes"),
        F.get_json_object(j, "$.target_distribution.No").cast("long").alias("readmission_no"),
        F.bround(F.get_json_object(j, "$.target_mean").cast("double"), 4).alias("target_mean"),
        F.bround(F.get_json_object(j, "$.target_std").cast("double"), 4).alias("target_std"),
        F.get_json_object(j, "$.train_accuracy").cast("double").alias("train_accuracy"),
        F.get_json_object(j, "$.test_accuracy").cast("double").alias("test_accuracy"),
        F.bround(F.get_json_object(j, "$.test_mae").cast("double"), 2).alias("test_mae"),
        F.bround(F.get_json_object(j, "$.test_rmse").cast("double"), 2).alias("test_rmse"),
        F.bround(F.get_json_object(j, "$.test_r2").cast("double"), 3).alias("test_r2"))


def fill_training_meta(bundle: ModelBundle, cases: DataFrame) -> ModelBundle:
    """Training-time metadata (sizes, metrics, target statistics); each is a
    small aggregate, so only a handful of numbers reach the driver.  ``trained_on_n``
    counts the labelled rows (as the reference does), ``fitted_on_n`` those of the fit."""
    d = labelled(bundle, cases)
    bundle.meta["trained_on_n"] = d.count()
    if bundle.kind == "risk":
        rep = {(r["split"], r["class"]): r for r in _classifier_report(bundle, d).collect()}
        for sp in ("train", "test"):
            bundle.meta[f"{sp}_accuracy"] = rep[(sp, "Yes")]["accuracy"] if (sp, "Yes") in rep else None
        counts = d.groupBy(READMISSION).count().collect()
        bundle.meta["target_distribution"] = {r[READMISSION]: r["count"] for r in counts}
    else:
        rep = {r["split"]: r for r in _regression_report(bundle, d).collect()}
        for sp in ("train", "test"):
            if sp in rep:
                for m in ("mae", "rmse", "r2"):
                    bundle.meta[f"{sp}_{m}"] = rep[sp][m]
        st = d.agg(F.avg("label").alias("m"), F.stddev_samp("label").alias("s")).first()
        bundle.meta["target_mean"], bundle.meta["target_std"] = st["m"], st["s"]
    return bundle
