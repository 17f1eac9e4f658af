"""Training-record sink and scans.

Each encoded record is stored once, in the folder of its validation fold:
``<root>/fold_id=<i>/part-*.parquet`` with columns ``key, xi array<int>, xv array<float>,
label float``. The (train, valid) sets of split i are read with partition pruning:
valid = ``fold_id = i``, train = ``fold_id <> i``. Storing K role copies (the reference's
layout) would multiply the written data by K for no information. Record width is checked on
read.

For mini-batches the records are stored by hash slice as well
(``<root>/records/fold_id=<i>/slice=<s>/``), beside the feature ids that each slice touches: a
step reads the files of its own slices, in an order that changes with the epoch.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import check_width


def sink_folds(folded: DataFrame, path: str, fold_col: str = "fold", mode: str = "overwrite") -> str:
    """Write records once, partitioned by fold. Every task writes its own files into each
    fold folder (no shuffle, no task ever holds a whole fold); file size is bounded by
    maxRecordsPerFile."""
    (folded.withColumnRenamed(fold_col, "fold_id")
     .write.mode(mode).option("maxRecordsPerFile", 1_000_000)
     .partitionBy("fold_id").parquet(path))
    return path


def scan_fold(spark: SparkSession, path: str, role: str, fold: int, field_size: int | None = None) -> DataFrame:
    """The train or valid records of split ``fold`` (partition-pruned scan)."""
    df = spark.read.parquet(path)
    sel = (F.col("fold_id") == fold) if role == "valid" else (F.col("fold_id") != fold)
    df = df.where(sel).drop("fold_id")
    return check_width(df, field_size) if field_size else df


def scan_splits(spark: SparkSession, path: str, k: int) -> DataFrame:
    """All (role, split) views at once: each stored record appears as ``valid`` in its own
    split and ``train`` in the k-1 others (a generator on read, not stored copies)."""
    df = spark.read.parquet(path)
    return (df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("role", F.when(F.col("fold_id") == F.col("split"), "valid").otherwise("train"))
            .drop("fold_id").withColumnRenamed("split", "fold_id"))


def sink_unlabelled(encoded: DataFrame, path: str, mode: str = "overwrite") -> str:
    encoded.drop("label").write.mode(mode).parquet(path)
    return path


def scan_unlabelled(spark: SparkSession, path: str, key: str, field_size: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).select(key, "xi", "xv")
    return check_width(df, field_size) if field_size else df


SLICE_ROWS = 50_000  # records of a slice: one task's work


def sink_sliced(folded: DataFrame, path: str, key: str, n_slices: int, fold_col: str = "fold", mode: str = "overwrite") -> str:
    """Write records by fold and hash slice of the key, and (fold_id, slice, feature_id) of the ids
    that occur: one row per slice, however many records hold the id."""
    spark = folded.sparkSession
    rows = folded.withColumnRenamed(fold_col, "fold_id").withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n_slices)).cast("int"))
    stored = os.path.join(path, "records")
    rows.repartition("fold_id", "slice").write.mode(mode).partitionBy("fold_id", "slice").parquet(stored)
    ids = spark.read.schema(rows.schema).parquet(stored).select("fold_id", "slice", F.explode("xi").alias("feature_id"))
    ids = ids.withColumn("feature_id", F.col("feature_id").cast("bigint"))
    (ids.distinct().repartition("fold_id", "slice").write.mode(mode).partitionBy("fold_id", "slice")
     .parquet(os.path.join(path, "touched")))
    return path


class SlicedRecords:
    """The train or valid records of one split, read slice by slice (all folds: ``fold`` None)."""

    def __init__(self, spark: SparkSession, path: str, role: str = "train", fold: int | None = None):
        self.spark, self.path = spark, path
        sel = F.lit(True) if fold is None else (F.col("fold_id") == fold) if role == "valid" else (F.col("fold_id") != fold)
        self.records = spark.read.parquet(os.path.join(path, "records")).where(sel)
        self.touched = spark.read.parquet(os.path.join(path, "touched")).where(sel)
        # partition values: as many as there are slices
        self.slices = sorted(r["slice"] for r in self.touched.select("slice").distinct().collect())

    def chosen(self, epoch: int, batch: int, n_batches: int) -> list[int]:
        """Slices of a mini-batch: every ``n_batches``-th of the epoch's own order."""
        order = sorted(self.slices, key=lambda s: hashlib.md5(f"{epoch}:{s}".encode()).hexdigest())
        return order[batch::n_batches]

    def batch(self, epoch: int, batch: int, n_batches: int) -> DataFrame:
        return self.records.where(F.col("slice").isin(self.chosen(epoch, batch, n_batches)))

    def touched_by(self, epoch: int, batch: int, n_batches: int) -> DataFrame:
        return self.touched.where(F.col("slice").isin(self.chosen(epoch, batch, n_batches)))
