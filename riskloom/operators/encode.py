"""Sparse (feature id, value) encoding of rows against a fitted feature dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionary import FeatureDictionary, impute_id
from .joins import MAX_BROADCAST_BYTES, lookup_join, table_bytes


def lookup_ids(df: DataFrame, fd: FeatureDictionary, seed: int = 42,
               impute: bool = True) -> DataFrame:
    """Add ``_id_<field>`` for every categorical field: the value's feature id, or (unseen /
    null) the field's seeded smallest-or-largest id. One lookup join per field; a lookup side is
    broadcast only while all broadcast sides together stay within the bound. Beyond it the rows
    are staged, nulls and heavy values keep out of the shuffle, and the rest is joined by it."""
    out = df
    room = MAX_BROADCAST_BYTES
    for f in fd.fields:
        if fd.kinds[f] != "categorical":
            continue
        lookup = (fd.table.where((F.col("field") == f) & (F.col("kind") == "categorical"))
                  .select(F.col("value").alias(f"_v_{f}"), F.col("feature_id").alias(f"_id_{f}")))
        out = lookup_join(out, lookup, F.col(f).cast("string"), f"_v_{f}", right_rows=fd.sizes[f], max_broadcast_bytes=room)
        if table_bytes(lookup, fd.sizes[f]) <= room:
            room -= table_bytes(lookup, fd.sizes[f])
        if impute:
            out = out.withColumn(f"_id_{f}", F.coalesce(F.col(f"_id_{f}"),
                                                        F.lit(impute_id(fd, f, seed)).cast("long")))
    return out


def encode_xi_xv(df: DataFrame, fd: FeatureDictionary, key: str, target: str | None = None,
                 seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Rows → ``(key, xi array<int>, xv array<float>[, label float])``.

    numeric field: id = the field's id, value = the column value;
    categorical field: id = the value's id (unseen → seeded field min/max), value = 1.
    Ignored columns are dropped; the label is kept aside.
    """
    with_ids = lookup_ids(df, fd, seed)
    xi, xv = [], []
    for f in fd.fields:
        if fd.kinds[f] == "numeric":
            xi.append(F.lit(fd.offsets[f]).cast("int"))
            xv.append(F.col(f).cast("float"))
        else:
            xi.append(F.col(f"_id_{f}").cast("int"))
            xv.append(F.lit(1.0).cast("float"))
    cols = [F.col(key), F.array(*xi).alias("xi"), F.array(*xv).alias("xv")]
    if target and target in df.columns:
        cols.append(F.col(target).cast("float").alias("label"))
    for k in keep or []:
        cols.append(F.col(k))
    return with_ids.select(*cols)


def check_width(df: DataFrame, field_size: int, cols=("xi", "xv")) -> DataFrame:
    """Fail the job on a record of the wrong width (the reference's fixed-length reshape)."""
    # the check lives inside the column itself, so column pruning cannot drop it
    return df.withColumns({
        c: F.when(F.size(c) == field_size, F.col(c)).otherwise(
            F.raise_error(F.lit(f"{c} must have {field_size} entries"))) for c in cols})


def long_form(encoded: DataFrame, key: str) -> DataFrame:
    """``(key, field, feature_id, value)``: one row per (record, field)."""
    return encoded.select(key, F.posexplode(F.arrays_zip("xi", "xv")).alias("field", "z")).select(
        key, F.col("field").cast("int").alias("field"),
        F.col("z.xi").cast("long").alias("feature_id"), F.col("z.xv").cast("double").alias("value"))
