"""Loan-shaped fixture over the provided star schema.

``app`` = orders ⋈ customer ⋈ nation with nulls, an unseen category and a constant column
injected by key arithmetic (the provided tables hold no nulls). Every order row is used:
``slice`` assigns each row to one of the three roles (0 bank, 1 internet, 2 test), it does
not thin the data. The same definition exists as DuckDB SQL in ``APP_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

APP_COLUMNS = ("loan_id", "user_id", "slice", "total_loan", "f0", "f1", "f2", "class_raw",
               "employer_type", "industry", "work_year", "issue_date", "is_default")


def app_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    max_key = orders.select(F.max("o_orderkey")).scalar()

    k = F.col("o_orderkey")
    wy = F.col("o_custkey") % 13
    work_year = (F.when(wy == 12, F.lit(None).cast("string"))
                 .when(wy == 11, F.lit("n/a"))
                 .when(wy == 10, F.lit("10+ years"))
                 .when(wy == 0, F.lit("< 1 year"))
                 .when(wy == 1, F.lit("1 year"))
                 .otherwise(F.concat(wy.cast("string"), F.lit(" years"))))
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              # nation is a fixed 25-row dimension: its broadcast size is bounded by definition
              .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.select(
        k.alias("loan_id"),
        F.col("o_custkey").alias("user_id"),
        (k % 3).alias("slice"),
        F.col("o_totalprice").alias("total_loan"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("f0"),
        F.lit(0.0).cast("double").alias("f1"),
        F.when((k % 5 == 0) | (k >= max_key - 9), F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") / 100.0).alias("f2"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
         .alias("class_raw"),
        F.col("c_mktsegment").alias("employer_type"),
        F.when((k % 3 == 1) & (F.col("c_nationkey") == 24), F.lit("OFFSHORE"))
         .otherwise(F.col("n_name")).alias("industry"),
        work_year.alias("work_year"),
        F.col("o_orderdate").alias("issue_date"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("is_default"),
    )


def loan_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three differently shaped source tables of the reference, cut from ``app``.

    bank: label already named ``isDefault``, plus a bank-only column;
    internet: label still ``is_default``, plus an internet-only column;
    test: no label.
    """
    app = app_view(spark, sf_dir)
    bank = (app.where(F.col("slice") == 0).withColumnRenamed("is_default", "isDefault")
            .withColumn("bank_only", F.col("total_loan") * 2))
    internet = (app.where(F.col("slice") == 1)
                .withColumn("internet_only", F.col("user_id") % 2))
    test = app.where(F.col("slice") == 2).drop("is_default")
    return {"bank": bank, "internet": internet, "test": test}


# The same fixture in DuckDB SQL, used as a CTE by the oracle queries.
APP_SQL = """
app AS (
  SELECT o_orderkey AS loan_id,
         o_custkey AS user_id,
         o_orderkey % 3 AS slice,
         o_totalprice AS total_loan,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_acctbal END AS f0,
         CAST(0.0 AS DOUBLE) AS f1,
         CASE WHEN o_orderkey % 5 = 0 OR o_orderkey >= (SELECT max(o_orderkey) - 9 FROM orders)
              THEN NULL ELSE o_totalprice / 100.0 END AS f2,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS class_raw,
         c_mktsegment AS employer_type,
         CASE WHEN o_orderkey % 3 = 1 AND c_nationkey = 24 THEN 'OFFSHORE' ELSE n_name END
           AS industry,
         CASE WHEN o_custkey % 13 = 12 THEN NULL
              WHEN o_custkey % 13 = 11 THEN 'n/a'
              WHEN o_custkey % 13 = 10 THEN '10+ years'
              WHEN o_custkey % 13 = 0 THEN '< 1 year'
              WHEN o_custkey % 13 = 1 THEN '1 year'
              ELSE concat(CAST(o_custkey % 13 AS VARCHAR), ' years') END AS work_year,
         o_orderdate AS issue_date,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS is_default
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
