"""The bucketed ordered pass equals a single global window, whatever the bucketing and
partitioning."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import ordered


def _data(spark, null_every=3):
    rows = [(i, (i * 37) % 11, None if i % null_every == 0 else float(i % 17)) for i in range(300)]
    return spark.createDataFrame(rows, "k long, g long, v double")


@pytest.mark.parametrize("buckets", [1, 2, 7])
@pytest.mark.parametrize("parts", [1, 13])
def test_backfill_matches_window(spark, buckets, parts):
    df = _data(spark).repartition(parts)
    b = ordered.with_quantile_bucket(df, "k", buckets)
    got = ordered.backfill(b, ["v"], ["k"], ordered.BUCKET).select("k", "v")
    w = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    want = df.select("k", F.first("v", ignorenulls=True).over(w).alias("v"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_backfill_all_null_and_keyed(spark):
    df = spark.createDataFrame([(i, i % 3, None) for i in range(50)], "k long, g long, v double")
    b = ordered.with_quantile_bucket(df, "k", 5)
    got = ordered.backfill(b, ["v"], ["k"], ordered.BUCKET, partition_by=["g"])
    assert got.where(F.col("v").isNotNull()).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_row_number_and_running_sum(spark, buckets):
    df = _data(spark).repartition(7)
    b = ordered.with_quantile_bucket(df, "k", buckets)
    got = ordered.running(b, {"rn": ordered.Agg("count", F.lit(1)), "s": ordered.Agg("sum", F.col("v")),
                              "mx": ordered.Agg("max", F.col("v"))}, ["k"], ordered.BUCKET,
                          partition_by=["g"]).select("k", "rn", "s", "mx")
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", F.count(F.lit(1)).over(w).alias("rn"), F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"),
                     F.max("v").over(w).alias("mx"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hash_rank_partition_independent(spark):
    from riskloom.operators.split import shuffle_rows
    df = spark.range(500).withColumnRenamed("id", "k")
    a = shuffle_rows(df.repartition(1), "k", 42)
    b = shuffle_rows(df.repartition(13), "k", 42)
    assert a.exceptAll(b).count() == 0
    assert sorted(r["position"] for r in a.collect()) == list(range(500))
