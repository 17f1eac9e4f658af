"""Fold invariants on the loan fixture."""
from pyspark.sql import functions as F

from riskloom.operators.split import expand_folds, stratified_kfold
from riskloom.sources.fixtures import app_view

from paths import SF_SMALL


def test_stratified_folds_balanced(spark):
    app = app_view(spark, SF_SMALL).select("loan_id", "is_default")
    f = stratified_kfold(app, "is_default", "loan_id", 3, 42)
    assert f.count() == app.count()
    sizes = f.groupBy("is_default", "fold").count().collect()
    for label in (0, 1):
        c = [r["count"] for r in sizes if r["is_default"] == label]
        assert len(c) == 3 and max(c) - min(c) <= 1


def test_each_row_valid_once(spark):
    app = app_view(spark, SF_SMALL).select("loan_id", "is_default")
    ex = expand_folds(stratified_kfold(app, "is_default", "loan_id", 3, 42), 3)
    v = ex.where(F.col("role") == "valid").groupBy("loan_id").count()
    assert v.where(F.col("count") != 1).count() == 0 and v.count() == app.count()
    t = ex.where(F.col("role") == "train").groupBy("loan_id").count()
    assert t.where(F.col("count") != 2).count() == 0


def test_folds_partition_independent(spark):
    app = app_view(spark, SF_SMALL).select("loan_id", "is_default")
    a = stratified_kfold(app.repartition(1), "is_default", "loan_id", 3, 42)
    b = stratified_kfold(app.repartition(13), "is_default", "loan_id", 3, 42)
    assert a.exceptAll(b).count() == 0
