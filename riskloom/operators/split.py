"""Seeded sampling, stratified folds, row numbering, shuffling and batching.

Every random choice is a seeded md5 order (identical in DuckDB), never ``rand()``, so
results do not depend on partitioning. Ranks within a class use the bucketed ordered pass,
so a class holding most rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

HASH = "_hkey"


def hex_digits_for(spark) -> int:
    """Leading md5 hex digits per bucket: 16**digits ≈ the session's bucket count (which
    follows ``spark.sql.shuffle.partitions``, i.e. the cluster size), between 2 and 5
    (at most ~1M bucket rows ever reach a summary table or the driver)."""
    import math
    from ..session import default_buckets
    return min(5, max(2, math.ceil(math.log(default_buckets(spark), 16))))


def _hash_ranked(df: DataFrame, key: str, seed, partition_by=(), out: str = "rank",
                 hex_digits: int | None = None) -> DataFrame:
    """0-based rank by md5(key:seed), then key, within ``partition_by``."""
    hex_digits = hex_digits or hex_digits_for(df.sparkSession)
    d = df.withColumn(HASH, ordered.hash_order_key(key, seed))
    # with a class key the summary has (classes × buckets) rows: no fixed bound, so it takes
    # the normal join (the ranked side is already partitioned by the keys; AQE may still
    # broadcast it from runtime sizes); without one it is bucket-sized and broadcast
    r = ordered.row_number(d, [HASH, key], ordered.hex_bucket(HASH, hex_digits),
                           partition_by=partition_by, out=out)
    return r.drop(HASH)


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class (one tiny aggregate; one row per class value)."""
    return {r[label]: int(r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def undersample_balance(df: DataFrame, label: str, key: str, seed: int,
                        minority=1, majority=0) -> DataFrame:
    """Keep every minority row and exactly as many majority rows, chosen without replacement
    by seeded hash order. Raises if the majority class is smaller than the minority."""
    sizes = class_sizes(df, label)
    n_min, n_maj = sizes.get(minority, 0), sizes.get(majority, 0)
    if n_maj < n_min:
        raise ValueError(f"majority class has {n_maj} rows, fewer than the {n_min} to sample")
    picked = hash_top_n(df.where(F.col(label) == majority), key, seed, n_min)
    return df.where(F.col(label) == minority).unionByName(picked)


def hash_top_n(df: DataFrame, key: str, seed, n: int, hex_digits: int | None = None) -> DataFrame:
    """The ``n`` rows first in md5(key:seed), key order — without ranking every row.

    One aggregate gives rows per hash bucket (a bucket-sized table); buckets wholly below the
    cut are kept as they are, and only the one bucket the cut falls in is ranked.
    """
    hex_digits = hex_digits or hex_digits_for(df.sparkSession)
    d = df.withColumn(HASH, ordered.hash_order_key(key, seed)).withColumn(
        "_hb", ordered.hex_bucket(HASH, hex_digits))
    from pyspark.sql import Window
    counts = d.groupBy("_hb").agg(F.count(F.lit(1)).alias("n"))
    # running totals over the bucket table (at most 16**digits rows); one row comes back
    upto = counts.select("_hb", "n", F.sum("n").over(Window.orderBy("_hb")).alias("upto"))
    first = upto.where(F.col("upto") >= n).agg(F.min(F.struct("_hb", "n", "upto")).alias("c")).first()["c"]
    if first is None:
        return df
    cut, need = first["_hb"], n - (first["upto"] - first["n"])
    whole = d.where(F.col("_hb") < cut)
    w = Window.partitionBy("_hb").orderBy(HASH, key)
    edge = (d.where(F.col("_hb") == cut).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= need).drop("_r"))
    return whole.unionByName(edge).drop(HASH, "_hb")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int, seed: int,
                     out: str = "fold") -> DataFrame:
    """Fold = (rank within class by md5(key:seed), key) mod k: every row is validation once,
    per-class fold sizes differ by at most one."""
    r = _hash_ranked(df, key, seed, partition_by=[label], out="_r")
    return r.withColumn(out, (F.col("_r") % k).cast("int")).drop("_r")


def plain_kfold(df: DataFrame, key: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    r = _hash_ranked(df, key, seed, out="_r")
    return r.withColumn(out, (F.col("_r") % k).cast("int")).drop("_r")


def expand_folds(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Each row appears once per split: ``valid`` in its own fold, ``train`` in the k-1
    others (a generator over 0..k-1, not a join)."""
    return (df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("role", F.when(F.col(fold_col) == F.col("split"), "valid").otherwise("train")))


def take_fold(df: DataFrame, i: int, role: str, fold_col: str = "fold") -> DataFrame:
    return df.where(F.col(fold_col) == i) if role == "valid" else df.where(F.col(fold_col) != i)


def renumber_rows(df: DataFrame, key: str, out: str = "index", n_buckets: int | None = None) -> DataFrame:
    """0..n-1 in key order (pandas ``reset_index``) without a single-task window."""
    from ..session import default_buckets
    nb = n_buckets or default_buckets(df.sparkSession)
    b = ordered.with_quantile_bucket(df, key, nb)
    return ordered.row_number(b, [key], ordered.BUCKET, out=out).drop(ordered.BUCKET)


def shuffle_rows(df: DataFrame, key: str, seed, out: str = "position") -> DataFrame:
    """Seeded permutation: position of each row in md5(key:seed) order."""
    return _hash_ranked(df, key, seed, out=out)


def batch_rows(df: DataFrame, key: str, batch_size: int, seed=None, drop_remainder: bool = True,
               out: str = "batch_id", n_buckets: int | None = None) -> DataFrame:
    """Fixed-size batches in key order (or seeded shuffle order); optionally drop the last
    incomplete batch."""
    if seed is None:
        r = renumber_rows(df, key, out="_r", n_buckets=n_buckets)
    else:
        r = shuffle_rows(df, key, seed, out="_r")
    r = r.withColumn(out, F.floor(F.col("_r") / batch_size).cast("long"))
    if drop_remainder:
        n = df.count()
        r = r.where(F.col("_r") < (n // batch_size) * batch_size)
    return r.drop("_r")
