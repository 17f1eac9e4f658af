"""Text keys of which one is odd, and more buckets than the driver cuts, still make even buckets."""
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordered
from riskloom.operators.split import renumber_rows


@pytest.mark.parametrize("odd", ["", "zzz"])
def test_odd_key_does_not_crowd_a_bucket(spark, odd):
    keys = [odd, *[f"LOAN-2021-{i:06d}" for i in range(2000)]]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    sizes = ordered.with_quantile_bucket(df, "k", 8).groupBy(ordered.BUCKET).agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 2 * len(keys) / 8 + 1
    got = {r["k"]: r["index"] for r in renumber_rows(df, "k", n_buckets=8).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def ordered_and_even(df, col, n_buckets, most):
    """Buckets follow the key's order, equal keys share one, and none is above ``most`` rows."""
    b = ordered.with_quantile_bucket(df, col, n_buckets)
    assert b.columns == [*df.columns, ordered.BUCKET] and dict(b.dtypes)[ordered.BUCKET] == "int"
    spans = (b.where(F.col(col).isNotNull() & ~F.col(col).cast("string").eqNullSafe("NaN")).groupBy(ordered.BUCKET)
             .agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count("*").alias("n")).orderBy(ordered.BUCKET).collect())
    assert all(a["high"] < z["low"] for a, z in zip(spans, spans[1:]))
    assert max(r["n"] for r in spans if r["low"] != r["high"]) <= most
    return b, spans


def test_awkward_texts(spark):
    keys = ["", "a", "a\0", "a\0\0", "a" * 300, "a" * 300 + "b", "é", "漢字", "😀", *["same"] * 700,
            *[f"https://site/{'p/' * (i % 5)}{i}" for i in range(400)], *["x" * 20 + "\0" * i for i in range(80)], None, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    b, _ = ordered_and_even(df, "k", 40, 2 * (len(keys) - 2) / 40 + 1)
    assert b.count() == len(keys)
    assert {r[ordered.BUCKET] for r in b.where("k is null").collect()} == {None}  # sorts first, as the key
    got = {r["k"]: r["i"] for r in renumber_rows(df.dropDuplicates(), "k", "i", 40).collect()}
    assert got == {k: i for i, k in enumerate([None, *sorted({k for k in keys if k is not None}, key=str.encode)])}


@pytest.mark.parametrize("kind", ["long", "double", "timestamp", "date"])
def test_more_buckets_than_the_driver_cuts(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered, "COARSE", 8)
    n = F.col("id")
    # a third of the rows hold one key
    key = F.when(n % 3 == 0, 5000).otherwise(n * n % 9973)
    key = {"long": key.cast("long"), "double": F.when(n == 1, None).when(n == 2, float("nan")).otherwise(key / 7),
           "timestamp": F.timestamp_seconds(key * 1000), "date": F.date_add(F.lit("1990-01-01").cast("date"), key.cast("int"))}[kind]
    df = spark.range(4000).select("id", key.alias("k")).repartition(5)
    b, spans = ordered_and_even(df, "k", 200, 2 * 4000 / 200 + 1)
    assert b.count() == 4000 and 60 < len(spans) < 600
    last = b.agg(F.max(ordered.BUCKET)).first()[0]
    if kind == "double":
        assert {r["id"]: r[ordered.BUCKET] for r in b.where("id in (1, 2)").collect()} == {1: None, 2: last}


def test_empty_and_single(spark):
    for rows in ([], [(None,)], [("only",)] * 50):
        df = spark.createDataFrame(rows, "k string")
        assert ordered.with_quantile_bucket(df, "k", 4).count() == len(rows)
