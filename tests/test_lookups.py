"""Lookups with heavy and null keys: equal to a plain join, and no task holds much more than its share."""
import pytest
from pyspark.sql import functions as F

from riskloom.operators import assemble, joins
from riskloom.operators.dictionary import apply_dictionary
from riskloom.operators.interact import embedding_lookup


def skewed(spark, n=30_000):
    """A third of all rows hold one key, a sixth hold none."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 == 1, None)
                                 .otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("key"))


def table(spark):
    return spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("value"), F.col("id").alias("code")).unionByName(
        spark.createDataFrame([("hot", -1)], "value string, code bigint"))


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are beyond every broadcast limit, partitions as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_a_plain_join(spark, how):
    left, right = skewed(spark), table(spark)
    want = left.join(right, left["key"] == right["value"], how).select("id", "key", "code")
    for got in (joins.skew_lookup(left, right, "key", "value", how),
                joins.skew_lookup(left, right, "key", "value", how, heavy=[]),
                joins.lookup_join(left, right, "key", "value", how, max_broadcast_bytes=0),
                joins.lookup_join(left, right, "key", "value", how)):
        got = got.select("id", "key", "code")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_heavy_keys_are_counted_exactly(spark):
    left = skewed(spark)
    h = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert joins.heavy_keys(left, "key", 0.01) == [h]
    assert joins.heavy_keys(left.limit(0), "key") == []


def largest(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n)


def test_no_task_holds_the_hot_key(spark, no_broadcast):
    left, right = skewed(spark), table(spark)
    plain, total = largest(left.join(right, left["key"] == right["value"], "left").select("id", "code"))
    split, same = largest(joins.skew_lookup(left, right, "key", "value").select("id", "code"))
    parts = 8
    assert total == same == 30_000
    assert plain > 2 * total / parts and split <= 2 * total / parts


def test_dictionary_and_embeddings_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(joins.lookup_join, "__defaults__",
                        tuple(0 if d == joins.MAX_BROADCAST_BYTES else d for d in joins.lookup_join.__defaults__))
    left, right = skewed(spark, 3000), table(spark)
    out = apply_dictionary(left, "key", right)
    want = {r["id"]: r["code"] for r in left.join(right, left["key"] == right["value"], "left").collect()}
    assert {r["id"]: r["key"] for r in out.collect()} == want
    long = spark.range(900).select(F.col("id").alias("k"), F.lit(0).alias("field"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("feature_id"),
                                   F.lit(1.0).alias("value"))
    emb = spark.range(900).select(F.col("id").alias("feature_id"), F.array(F.col("id").cast("double")).alias("w"))
    got = {r["k"]: (r["feature_id"], r["w"][0]) for r in embedding_lookup(long, emb).collect()}
    assert got == {i: (0 if i % 2 == 0 else i, 0.0 if i % 2 == 0 else float(i)) for i in range(900)}


def test_out_of_fold_scatter_finds_doubles_and_gaps(spark):
    base = spark.range(10).select("id", (F.col("id") % 3).alias("fold"))
    per_fold = [base.where(F.col("fold") == i).select("id", F.lit(float(i)).alias("pred")) for i in range(3)]
    out = assemble.oof_assemble(per_fold, base, "id")
    assert [r["oof"] for r in out.orderBy("id").collect()] == [float(i % 3) for i in range(10)]
    short = assemble.oof_assemble(per_fold[:2], base, "id")
    assert {(r["fold"], r["rows"], r["missing"]) for r in assemble.missing_predictions(short, "fold").collect()} == {(0, 4, 0), (1, 3, 0), (2, 3, 3)}
    with pytest.raises(Exception, match="by no fold"):
        assemble.oof_assemble(per_fold[:2], base, "id", gaps="error").collect()
    with pytest.raises(Exception, match="by several folds"):
        assemble.oof_assemble([*per_fold, per_fold[0]], base, "id").collect()


def test_history_commits_are_idempotent(spark, tmp_path):
    from riskloom.sources.files import commit_history, read_history
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("r1", 0, 0.5), ("r1", 1, 0.6), ("r2", 0, 0.7)], "run string, epoch int, auc double")
    for df in (rows, rows, rows.where("run = 'r2'")):
        commit_history(df, path)
    commit_history(spark.createDataFrame([("r1", 2, 0.9)], rows.schema), path)
    got = sorted((r["run"], r["epoch"], r["auc"]) for r in read_history(spark, path).collect())
    assert got == [("r1", 0, 0.5), ("r1", 1, 0.6), ("r1", 2, 0.9), ("r2", 0, 0.7)]
