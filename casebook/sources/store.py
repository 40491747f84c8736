"""The record store: immutable Parquet files named by numbered manifests.

A version of the store is a manifest: a small table of data files with their rows and key
range.  A write puts new files beside the old ones and then publishes its manifest by one
rename, which fails if that number is taken.  So a write that stops half way changes
nothing that readers see, two writers cannot both publish one version, and a reader keeps
the version it began with.

* ``insert`` takes the highest id from the manifest; no record is read.
* ``update`` reads only the keys of the files whose key range meets the batch's, finds the
  files that hold touched keys, and rewrites only those.

The publishing rename must be atomic (HDFS and POSIX folders are).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.quantiles import kept
from casebook.operators.writes import apply_folded, assign_ids_from, fold_updates, named_fields, validate_inserts
from casebook.schema import CASE_SCHEMA, KEY, VALUE_COLUMNS

FILES = "file string, rows long, low long, high long"


class VersionTaken(RuntimeError):
    """Another writer has published this version."""


@dataclass
class Written:
    """What a write did: the version it published and the rows it did not take."""
    version: int
    rejected: DataFrame | None = None


class RecordStore:
    """A store of case records in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = KEY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- versions ---------------------------------------------------------------

    def _hadoop(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        return jvm, conf, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        jvm, conf, folder = self._hadoop()
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, rows, low, high) of a version, by default the last."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        return self.spark.read.schema(FILES).parquet(f"{self.path}/manifests/{known[-1] if version is None else version}")

    def _publish(self, version: int, files: DataFrame) -> int:
        staging = f"{self.path}/manifests/_staging-{uuid.uuid4().hex}"
        files.select("file", "rows", "low", "high").write.parquet(staging)
        jvm, conf, folder = self._hadoop()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
        path = jvm.org.apache.hadoop.fs.Path
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = path(folder, str(version))
        if folder.getFileSystem(conf).exists(target):
            raise VersionTaken(f"version {version} of {self.path} is already published")
        context.rename(path(staging), target, plain)  # does not replace what is there
        return version

    def _put(self, df: DataFrame) -> DataFrame:
        """New data files with the rows of ``df``; returns their manifest rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.select(*CASE_SCHEMA.names).write.parquet(folder)
        return self._described(folder)

    def _described(self, folder: str) -> DataFrame:
        at = F.col("_metadata.file_path")
        return (self.spark.read.schema(CASE_SCHEMA).parquet(folder).select(at.alias("file"), F.col(self.key).cast("long").alias("key"))
                .groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")))

    # -- reads ------------------------------------------------------------------

    def _scan(self, files: DataFrame) -> DataFrame:
        """The records of some files.  Their names pass the driver, as they do in every
        file scan."""
        names = sorted(r["file"] for r in files.select("file").collect())
        reader = self.spark.read.schema(CASE_SCHEMA)
        return reader.parquet(*names) if names else self.spark.createDataFrame([], CASE_SCHEMA)

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version, by default the last."""
        return self._scan(self.manifest(version))

    def highest_id(self, version: int | None = None) -> int:
        """The highest key, from the manifest alone; 0 in an empty store."""
        return self.manifest(version).agg(F.max("high")).first()[0] or 0

    # -- writes -----------------------------------------------------------------

    def create(self, df: DataFrame) -> Written:
        """The first version.  Rows are ranged by key, so that files have narrow key ranges."""
        if self.versions():
            raise VersionTaken(f"{self.path} exists")
        return Written(self._publish(0, self._put(df.repartitionByRange(self.key))))

    def append(self, df: DataFrame, on: int | None = None) -> Written:
        """The records of ``df`` beside those of version ``on`` (the last)."""
        version = self.versions()[-1] if on is None else on
        new = self._put(df)
        return Written(self._publish(version + 1, self.manifest(version).unionByName(new)))

    def insert(self, batch: DataFrame, order_cols) -> Written:
        """Complete rows are numbered on from the highest id, in the order of
        ``order_cols``, and appended; the others are returned as rejected."""
        version = self.versions()[-1]
        accepted, rejected = validate_inserts(batch)
        numbered = assign_ids_from(self.highest_id(version), accepted, order_cols, self.key)
        return Written(self.append(numbered, version).version, rejected)

    def update(self, updates: DataFrame, seq: str = "seq", set_col: str = "set_fields") -> Written:
        """The folded updates applied to the last version.  Rejected: the keys that no
        record has, with their number of updates.  A batch that touches nothing publishes
        nothing."""
        version = self.versions()[-1]
        fields = named_fields(updates, VALUE_COLUMNS, set_col)
        folded = kept(fold_updates(updates.where(F.col(self.key).isNotNull()), fields, self.key, seq, set_col))
        files = kept(self.manifest(version))
        low, high = folded.agg(F.min(self.key), F.max(self.key)).first()
        near = files.where(F.lit(low is not None) & (F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high)))
        keys = self._scan(near).select(F.col("_metadata.file_path").alias("file"), self.key) if low is not None and not near.isEmpty() else None
        if keys is None:
            return Written(version, folded.select(self.key, F.col("_n_updates").alias("n_updates")))
        met = kept(keys.where(F.col(self.key).between(low, high)).join(folded.select(self.key), self.key, "left_semi"))
        unmatched = folded.join(met, self.key, "left_anti").select(self.key, F.col("_n_updates").alias("n_updates"))
        touched = files.join(met.select("file").distinct(), "file", "left_semi")
        if not fields or touched.isEmpty():
            return Written(version, unmatched)
        new = self._put(apply_folded(self._scan(touched), folded, fields, self.key))
        untouched = files.join(touched.select("file"), "file", "left_anti")
        return Written(self._publish(version + 1, untouched.unionByName(new)), unmatched)
