"""Joins whose broadcast side is size-checked, plus materialisation of fitted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

# Fitted lookup tables up to this many bytes are shipped to every task; larger ones are
# joined by shuffle (AQE may still pick a broadcast from runtime sizes, and splits skew).
MAX_BROADCAST_BYTES = 64 << 20
TEXT_WIDTH = 64  # bytes reckoned for a text value


def materialize(df: DataFrame) -> DataFrame:
    """Stage a table as Parquet in the shared folder and read it back: lineage is cut, columns
    can be pruned, and the table survives the loss of any executor."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame, rows: int) -> int:
    """Bytes reckoned for ``rows`` rows of ``df``'s columns."""
    width = sum(TEXT_WIDTH if t in ("string", "binary") or "<" in t else 8 for _, t in df.dtypes)
    return rows * (width + 16)


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "left",
               right_rows: int | None = None,
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join, broadcasting ``right`` only when its reckoned size is known to be small.

    ``right_rows`` may be passed when the caller already knows the size; otherwise the
    right side is counted (callers pass materialised, aggregated tables, so this is cheap).
    """
    n = right.count() if right_rows is None else right_rows
    if table_bytes(right, n) <= max_broadcast_bytes:
        right = F.broadcast(right)
    return left.join(right, on, how)


HEAVY_SHARE = 1 / 512  # a key above this share of the rows is looked up in a broadcast table


def heavy_keys(df: DataFrame, key: Column | str, share: float = HEAVY_SHARE) -> list[int]:
    """xxhash64 of every non-null value of ``key`` that holds more than ``share`` of the rows, by
    exact counts (pre-aggregated, one hash and one count per distinct value are shuffled). At most
    1 / ``share`` numbers reach the driver."""
    k = F.col(key) if isinstance(key, str) else key
    counts = materialize(df.select(k.alias("k")).where("k is not null").groupBy(F.xxhash64("k").alias("h")).count())
    n = counts.agg(F.sum("count")).first()[0] or 0
    return [r["h"] for r in counts.where(F.col("count") > F.lit(share * n)).select("h").collect()]


def skew_lookup(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: str, how: str = "left",
                share: float = HEAVY_SHARE, heavy: list[int] | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per ``right_key``, which is dropped), without
    a hot task whatever the keys' frequencies.

    Rows whose key is null or heavy never reach the shuffle: they meet the few heavy rows of
    ``right`` as a broadcast table (at most 1 / ``share`` rows). The others hold at most ``share``
    of the rows per key and go by an ordinary shuffle join. ``left`` is read once to count and
    once per branch, so pass a table, not a long plan. ``heavy``: hashes from ``heavy_keys`` where
    the caller has them. ``how``: left or inner (inner drops null keys)."""
    if how not in ("left", "inner"):
        raise ValueError(how)
    k = F.col(left_key) if isinstance(left_key, str) else left_key
    kind = dict(right.dtypes)[right_key]
    left = left.withColumn("_k", k.cast(kind))  # one type, so that both sides hash alike
    heavy = heavy_keys(left, "_k", share) if heavy is None else heavy
    right = right.withColumnRenamed(right_key, "_rk")

    def often(c):
        return F.xxhash64(c).isin(heavy) if heavy else F.lit(False)

    hot_rows = left.where(F.col("_k").isNull() | often("_k"))
    rare_rows = left.where(F.col("_k").isNotNull() & ~often("_k"))
    on = F.col("_k") == F.col("_rk")
    hot = hot_rows.join(F.broadcast(right.where(often("_rk"))), on, how)
    rare = rare_rows.join(right.where(~often("_rk")), on, how)
    return hot.unionByName(rare).drop("_k", "_rk")


def lookup_join(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: str, how: str = "left",
                right_rows: int | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                share: float = HEAVY_SHARE, row_bytes: int | None = None) -> DataFrame:
    """A lookup on a unique key: ``right`` is broadcast while its reckoned bytes (``row_bytes`` a
    row, where the caller knows them) are within the bound; beyond it ``left`` is staged and goes by
    ``skew_lookup``. ``right_key`` is dropped."""
    n = right.count() if right_rows is None else right_rows
    if (n * row_bytes if row_bytes else table_bytes(right, n)) <= max_broadcast_bytes:
        k = F.col(left_key) if isinstance(left_key, str) else left_key
        right = right.withColumnRenamed(right_key, "_rk")
        return left.join(F.broadcast(right), k.cast(dict(right.dtypes)["_rk"]) == F.col("_rk"), how).drop("_rk")
    return skew_lookup(materialize(left), right, left_key, right_key, how, share)
