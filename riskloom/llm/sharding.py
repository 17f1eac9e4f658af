"""Sharding by jump consistent hashing, with gapless slots inside every shard.

A row's shard depends on its key and the shard count alone, and one more shard takes rows only
into itself; there is no ring or table of shards. Slots number a shard's rows from 0: rows are
counted per (shard, bucket of the key's hash), the counts become offsets, and only rows of one
bucket are ever sorted together. Equal rows travel as one counted row, so a key that holds a
third of all rows costs one row in the shuffle.

Defined results: a null key is a key of its own; null text has size 1 and crc32 0; repeated rows
each get their own slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import shuffle_partitions

STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys (Lamping and Veach, 2014), all keys at once."""
    key = keys.astype(np.uint64)
    bucket = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * STEP + np.uint64(1)
        spread = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((bucket[live] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a key column of any type."""
    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign(df: DataFrame, key: str, columns: dict[str, Column], shards: int = 16) -> DataFrame:
    """Every row's key, the given narrow columns, ``shard``, ``slot`` and ``grown_shard`` (its
    shard were there one more)."""
    spark = df.sparkSession
    ship_package(spark)
    names = [key, *columns]
    units = (df.select(F.col(key), *[c.alias(n) for n, c in columns.items()])
             .groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    units = units.select("*", shard_of(F.col(key), shards).alias("shard"),
                         shard_of(F.col(key), shards + 1).alias("grown_shard"))
    buckets = 4 * shuffle_partitions(spark)
    units = units.withColumn("_bucket", F.pmod(F.xxhash64(*names, F.lit("slot")), F.lit(buckets)).cast("int"))
    # one row per (shard, bucket): shards x buckets rows, whatever the input
    totals = units.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = (Window.partitionBy("shard", "_bucket").orderBy(*[F.col(n).asc_nulls_first() for n in names])
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (units.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0)))
              .join(offsets, ["shard", "_bucket"]))
    return placed.select(*names, "shard", "grown_shard",
                         F.explode(F.sequence(F.col("_first") + F.col("_at"),
                                              F.col("_first") + F.col("_at") + F.col("_n") - 1)).alias("slot"))


def write_shards(df: DataFrame, key: str, path: str, shards: int = 16) -> None:
    """Write whole rows under ``path/shard=k``; a shard is written by many tasks."""
    ship_package(df.sparkSession)
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = assign(df, doc_id, {"size": (F.octet_length(data) + 1).cast("long"), "text_crc32": F.crc32(data)}, shards)
    return out.select(doc_id, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
