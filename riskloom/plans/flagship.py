"""Flagship query: the minimum end-to-end slice of the cleaning and splitting plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import stratified_kfold
from ..roles import APP_ROLES
from ..sources.fixtures import loan_tables
from .common import K, SEED, finalize
from .prepare import app_spec, prepare


def fold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = loan_tables(spark, sf_dir)
    prep = prepare(t["bank"], t["internet"], t["test"], APP_ROLES, SEED, app_spec(), balance=False)
    folds = stratified_kfold(prep.scaled, "isDefault", "loan_id", K, SEED)
    return finalize(folds.groupBy("fold", "isDefault").agg(
        F.count(F.lit(1)).alias("n"), F.avg("total_loan").alias("mean_scaled_loan")))
