"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

# White space that separates words everywhere in this subpackage (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from these
    files, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as text; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(column(doc_id).cast("string"), F.lit("")).cast("binary"))


def uniform(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from the hash of the parts."""
    return F.expr("1D") * F.shiftrightunsigned(F.xxhash64(*[column(p) for p in parts]), 11) / F.lit(float(1 << 53))


def class_sample(df: DataFrame, label: str, per_class: int, *key: str) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of every value of ``label`` (all, if fewer), drawn by the hash of
    ``key``: each row by itself, so no class meets in one task. For fitting classifiers only.
    The classes and their sizes come to the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    rate = F.lit(0.0)
    for value, n in sizes.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    return df.where(uniform(F.lit("class-sample"), *key) < rate), sizes
