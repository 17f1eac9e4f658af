"""Bucket counts, hot ties, text keys and plan shapes."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF_SMALL
from riskloom.operators import dictionary as D
from riskloom.operators import metrics as M
from riskloom.operators import ordered
from riskloom.operators import split as S


def test_many_buckets_stay_distinct(spark):
    df = spark.range(2_000_000).select((F.col("id") * 7 + 3).alias("k"))
    b = ordered.with_quantile_bucket(df, "k", 100_000)
    assert b.select(ordered.BUCKET).distinct().count() > 90_000


def test_ties_are_spread(spark):
    df = spark.range(300_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"), F.col("id").alias("k"))
    counts = D.value_counts(df, "c", "k").withColumn("neg_cnt", -F.col("cnt"))
    sizes = ordered.with_pair_bucket(counts, "neg_cnt", "first_seen", 64).groupBy(ordered.BUCKET).count()
    most, mean, n = sizes.agg(F.max("count"), F.avg("count"), F.count("*")).first()
    assert n > 50 and most <= 2 * mean


def test_text_keys_and_codes(spark):
    keys = [f"loan-{i * 7919 % 100003:08d}-é" for i in range(3000)] + ["loan-", "zz", "a"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["index"] for r in S.renumber_rows(df, "k", n_buckets=40).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda s: s.encode()))}
    codes = {r["k"]: r["code"] for r in D.category_codes(df, "k").collect()}
    assert codes == got


def _initial(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    ev = spark.range(300).select((F.col("id") % 7 / 7.0).alias("p"), (F.col("id") % 2).cast("int").alias("y"),
                                 (F.col("id") % 3).cast("int").alias("fold"), F.lit("m").alias("model"))
    assert "Cartesian" not in _initial(M.cv_summary(ev, ["model"], "fold", "p", "y"))
    oof = _initial(E.queries()["oof_assemble"](spark, SF_SMALL))
    assert oof.count("FileScan") <= 4 and oof.count("Exchange hashpartitioning") <= 6
    fill = _initial(E.queries()["backfill_global"](spark, SF_SMALL))
    assert fill.count("FileScan") <= 2


def test_missing_scores_do_not_move_the_auc(spark):
    ev = spark.range(1000).select((F.col("id") * 37 % 101 / 101.0).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    holes = ev.union(spark.range(200).select(F.lit(None).cast("double"), F.lit(1))).union(
        spark.range(50).select(F.lit(float("nan")), F.lit(0)))
    for auc in (M.auc_exact, M.auc_thresholded):
        assert abs(auc(ev, "p", "y").first()["auc"] - auc(holes, "p", "y").first()["auc"]) < 1e-12
    assert tuple(M.missing_scores(holes, "p", "y").first()) == (250, 1250)


def test_loan_roles():
    from riskloom.roles import LOAN_ROLES
    cols = ["loan_id", "total_loan", "f1", "title", "class", "issue_date_y", "isDefault"]
    assert [LOAN_ROLES.kind(c) for c in cols] == ["ignore", "numeric", "ignore", "ignore", "categorical", "numeric", "ignore"]
    assert LOAN_ROLES.used(cols) == ["total_loan", "class", "issue_date_y"]
