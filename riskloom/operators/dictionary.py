"""Learned dictionaries: frequency codes, first-seen ids and the global feature dictionary.

Row order is data here, so every function takes an explicit, unique ``order_key``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import Roles
from ..session import default_buckets
from . import ordered
from .joins import lookup_join, materialize


def value_counts(df: DataFrame, col: str, order_key: str) -> DataFrame:
    """(value, cnt, first_seen) for the non-null values of ``col`` (map-side combined)."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.min(order_key).alias("first_seen")))


def freq_dictionary(df: DataFrame, col: str, order_key: str, n_buckets: int | None = None) -> DataFrame:
    """Most frequent value → code 0; ties broken by first appearance; nulls excluded.

    Returns a materialised ``(value, code)`` table.
    """
    counts = materialize(value_counts(df, col, order_key).withColumn("neg_cnt", -F.col("cnt")))
    nb = n_buckets or default_buckets(df.sparkSession)
    bucketed = ordered.with_pair_bucket(counts, "neg_cnt", "first_seen", nb)
    ranked = ordered.row_number(bucketed, ["neg_cnt", "first_seen"], ordered.BUCKET, out="code", stage=False)
    return materialize(ranked.select("value", F.col("code").cast("long").alias("code"),
                                     "cnt", "first_seen"))


def freq_dictionaries(df: DataFrame, cols: list[str], order_key: str,
                      n_buckets: int | None = None, with_sizes: bool = False):
    """``freq_dictionary`` for several columns from one scan: the columns are unpivoted to
    (field, value) and counted in one aggregate; codes are ranked per field."""
    long = df.select(order_key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [order_key], cols, "field", "value")
    counts = materialize(long.where(F.col("value").isNotNull()).groupBy("field", "value")
                         .agg(F.count(F.lit(1)).alias("cnt"), F.min(order_key).alias("first_seen"))
                         .withColumn("neg_cnt", -F.col("cnt")))
    nb = n_buckets or default_buckets(df.sparkSession)
    bucketed = ordered.with_pair_bucket(counts, "neg_cnt", "first_seen", nb)
    ranked = materialize(ordered.row_number(
        bucketed, ["neg_cnt", "first_seen"], ordered.BUCKET, partition_by=["field"], out="code",
        stage=False).select("field", "value", F.col("code").cast("long").alias("code"),
                                       "cnt", "first_seen"))
    dicts = {c: ranked.where(F.col("field") == c).drop("field") for c in cols}
    if not with_sizes:
        return dicts
    # one row per field: bounded by the number of dictionary columns
    sizes = {r["field"]: int(r["count"]) for r in ranked.groupBy("field").count().collect()}
    return dicts, {c: sizes.get(c, 0) for c in cols}


def apply_dictionary(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None,
                     dict_rows: int | None = None) -> DataFrame:
    """Replace ``col`` by its code; unknown values and nulls give null (left lookup join)."""
    out = out or col
    lookup = dictionary.select(F.col("value").alias("_dv"), F.col("code").alias("_dc"))
    key = F.col(col)
    if dict(lookup.dtypes)["_dv"] != dict(df.dtypes)[col]:
        key = key.cast(dict(lookup.dtypes)["_dv"])
    joined = lookup_join(df, lookup, key, "_dv", right_rows=dict_rows)
    cols = [F.col("_dc").alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(F.col("_dc").alias(out))
    return joined.select(*cols)


def category_codes(df: DataFrame, col: str, n_buckets: int | None = None) -> DataFrame:
    """pandas ``astype('category').cat.codes`` dictionary: distinct non-null values in
    alphabetical order → 0..n-1, as a ``(col, code)`` table, ranked by an ordered pass over
    the text."""
    distinct = materialize(df.where(F.col(col).isNotNull()).select(F.col(col), F.col(col).cast("string").alias("_text")).distinct())
    b = ordered.with_quantile_bucket(distinct, "_text", n_buckets or default_buckets(df.sparkSession))
    return ordered.row_number(b, ["_text"], ordered.BUCKET, out="code", stage=False).select(col, "code")


def distinct_first_seen(df: DataFrame, col: str, order_key: str,
                        n_buckets: int | None = None) -> DataFrame:
    """Distinct non-null values with their position in first-seen order."""
    firsts = materialize(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
                         .agg(F.min(order_key).alias("first_seen")))
    nb = n_buckets or default_buckets(df.sparkSession)
    b = ordered.with_quantile_bucket(firsts, "first_seen", nb)
    return ordered.row_number(b, ["first_seen"], ordered.BUCKET, out="position", stage=False).drop(ordered.BUCKET)


@dataclass
class FeatureDictionary:
    """Global feature id space: numeric field → one id; categorical → one id per value."""
    table: DataFrame              # (ord, field, kind, value, feature_id)
    fields: list[str]             # used columns in schema order
    kinds: dict[str, str]
    offsets: dict[str, int]
    sizes: dict[str, int]

    @property
    def feature_dim(self) -> int:
        return sum(self.sizes.values())

    @property
    def field_size(self) -> int:
        return len(self.fields)

    def field_range(self, field: str) -> tuple[int, int]:
        lo = self.offsets[field]
        return lo, lo + self.sizes[field] - 1


def fit_feature_dictionary(df: DataFrame, roles: Roles, order_key: str | None = None,
                           n_buckets: int | None = None) -> FeatureDictionary:
    """Walk the columns in order, skip ignored, give each numeric column one id and each
    distinct categorical value (first-seen order, nulls skipped) one id; offsets accumulate."""
    spark = df.sparkSession
    order_key = order_key or roles.key
    fields = roles.used(df.columns)
    kinds = {c: roles.kind(c) for c in fields}
    cats = [c for c in fields if kinds[c] == "categorical"]
    pos = {c: i for i, c in enumerate(fields)}

    if cats:
        long = df.select(order_key, *[F.col(c).cast("string").alias(c) for c in cats]).unpivot(
            [order_key], cats, "field", "value")
        firsts = materialize(long.where(F.col("value").isNotNull())
                             .groupBy("field", "value")
                             .agg(F.min(order_key).alias("first_seen")))
        # one size per categorical field: bounded by the schema width
        sizes_rows = firsts.groupBy("field").count().collect()
        cat_sizes = {r["field"]: int(r["count"]) for r in sizes_rows}
    else:
        firsts, cat_sizes = None, {}

    sizes, offsets, acc = {}, {}, 0
    for c in fields:
        sizes[c] = 1 if kinds[c] == "numeric" else cat_sizes.get(c, 0)
        offsets[c] = acc
        acc += sizes[c]

    num_rows = [(pos[c], c, "numeric", None, offsets[c]) for c in fields if kinds[c] == "numeric"]
    schema = "ord int, field string, kind string, value string, feature_id long"
    # schema-sized metadata rows (one per numeric column), not data
    table = spark.createDataFrame(num_rows, schema)
    if firsts is not None:
        nb = n_buckets or default_buckets(spark)
        b = ordered.with_quantile_bucket(firsts, "first_seen", nb)
        ranked = ordered.row_number(b, ["first_seen"], ordered.BUCKET, partition_by=["field"],
                                    out="rn", stage=False)
        off_map = F.create_map(*[x for c in cats for x in (F.lit(c), F.lit(offsets[c]))])
        pos_map = F.create_map(*[x for c in cats for x in (F.lit(c), F.lit(pos[c]))])
        cat_tab = ranked.select(
            pos_map[F.col("field")].cast("int").alias("ord"), "field",
            F.lit("categorical").alias("kind"), "value",
            (off_map[F.col("field")] + F.col("rn")).cast("long").alias("feature_id"))
        table = table.unionByName(cat_tab)
    return FeatureDictionary(materialize(table), fields, kinds, offsets, sizes)


def unknown_pick_is_max(field: str, seed: int) -> bool:
    """Seeded, per-field choice between the field's smallest and largest id for values the
    dictionary has never seen: md5(field:seed) with an odd leading hex digit → largest."""
    return int(hashlib.md5(f"{field}:{seed}".encode()).hexdigest()[0], 16) % 2 == 1


def impute_id(fd: FeatureDictionary, field: str, seed: int) -> int:
    lo, hi = fd.field_range(field)
    return hi if unknown_pick_is_max(field, seed) else lo
