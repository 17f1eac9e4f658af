"""Feature-interaction blocks as per-row array expressions (no shuffle, JVM-side).

A row carries its field embeddings as one flat array laid out field-major
(``[f0k0, f0k1, ..., f1k0, ...]``). Everything here is a projection: the number of fields and
the embedding size come from the schema/model, never from the data volume, so each row's
work is bounded. Weights are small model arrays (NumPy) turned into literal arrays.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import array_softmax
from .joins import lookup_join

LN_EPS = 1e-12


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.asarray(values).ravel()])


def as_double_array(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x.cast("double"))


def field_vector(arr: Column, f: int, dim: int) -> Column:
    return F.slice(arr, f * dim + 1, dim)


def _sum(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def fm_second_order(arr: Column, n_fields: int, dim: int) -> Column:
    """Per embedding dim k: ½[(Σ_f v_fk)² − Σ_f v_fk²] — the O(F) form of the pair sum."""
    def per_k(k):
        vals = [F.get(arr, k + f * dim) for f in range(n_fields)]
        s = _sum(vals)
        q = _sum([v * v for v in vals])
        return 0.5 * (s * s - q)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), per_k)


def pair_index(n_fields: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(n_fields), 2))


def pair_products(arr: Column, n_fields: int, dim: int) -> Column:
    """array<array<double>>: e_i ⊙ e_j for every field pair i < j (schema-bounded count)."""
    return F.array(*[F.zip_with(field_vector(arr, i, dim), field_vector(arr, j, dim),
                                lambda x, y: x * y) for i, j in pair_index(n_fields)])


def pair_dots(arr: Column, n_fields: int, dim: int) -> Column:
    """array<struct<i, j, dot>> over field pairs."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                              F.aggregate(F.zip_with(field_vector(arr, i, dim), field_vector(arr, j, dim),
                                                     lambda x, y: x * y),
                                          F.lit(0.0), lambda a, x: a + x).alias("dot"))
                     for i, j in pair_index(n_fields)])


def layer_norm(df: DataFrame, col: str, n_fields: int, dim: int, out: str,
               scale=None, shift=None, eps: float = LN_EPS) -> DataFrame:
    """Add ``out``: each field's embedding normalised over its ``dim`` entries, then scaled and
    shifted per entry by learned weights (default: unit scale, zero shift); variance as
    E[x²] − μ² so each field's slice is summed twice, not nested."""
    arr = F.col(col)
    g = lit_array(np.ones(dim) if scale is None else scale)   # dim numbers
    b = lit_array(np.zeros(dim) if shift is None else shift)
    parts = []
    for f in range(n_fields):
        v = field_vector(arr, f, dim)
        mu = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / dim
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / dim - mu * mu
        parts.append(F.transform(v, lambda x, k: (x - mu) / F.sqrt(var + eps) * F.get(g, k) + F.get(b, k)))
    return df.withColumn(out, F.flatten(F.array(*parts)))


def dense(x: Column, W: np.ndarray, b, activation: str | None = "relu") -> Column:
    """x · W + b for a literal (in × out) matrix; optional ReLU."""
    W = np.asarray(W, dtype=float)
    b = np.broadcast_to(np.asarray(b, dtype=float), (W.shape[1],))
    outs = []
    for j in range(W.shape[1]):
        z = F.aggregate(F.zip_with(x, lit_array(W[:, j]), lambda a, w: a * w),
                        F.lit(0.0), lambda a, t: a + t) + F.lit(float(b[j]))
        outs.append(F.greatest(z, F.lit(0.0)) if activation == "relu" else z)
    return F.array(*outs)


def softmax_gate(x: Column, W: np.ndarray, b) -> Column:
    """Gate weights over experts: softmax(x · W + b)."""
    return array_softmax(dense(x, W, b, activation=None))


def attention_pool(df: DataFrame, col: str, n_fields: int, dim: int, out: str,
                   mode: str = "as_reference", W=None, b=None, h=None) -> DataFrame:
    """Add ``out`` = Σ_pairs a_ij (e_i ⊙ e_j). ``as_reference``: every a_ij = 1 (the
    reference's softmax over a size-one axis); ``paper``: a = softmax_ij(h · relu(W·p_ij + b)).

    Intermediate arrays are staged as columns so each is computed once per row.
    """
    n_pairs = len(pair_index(n_fields))
    staged = df.withColumn("_ap_pairs", pair_products(F.col(col), n_fields, dim))
    if mode == "as_reference":
        staged = staged.withColumn("_ap_w", F.array_repeat(F.lit(1.0), n_pairs))
    else:
        staged = staged.withColumn("_ap_hidden", F.transform("_ap_pairs", lambda p: dense(p, W, b, "relu")))
        staged = staged.withColumn("_ap_s", F.transform("_ap_hidden", lambda hv: F.aggregate(
            F.zip_with(hv, lit_array(h), lambda a, c: a * c), F.lit(0.0), lambda a, t: a + t)))
        staged = staged.withColumn("_ap_w", array_softmax(F.col("_ap_s")))
    staged = staged.withColumn("_ap_weighted", F.zip_with(
        "_ap_pairs", "_ap_w", lambda p, a: F.transform(p, lambda x: x * a)))
    pooled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(
        F.col("_ap_weighted"), F.lit(0.0), lambda acc, p: acc + F.get(p, k)))
    return staged.withColumn(out, pooled).drop(*[c for c in staged.columns if c.startswith("_ap_")])


# ------------------------------------------------------------------ table (long) forms
def embedding_table(spark, emb: np.ndarray) -> DataFrame:
    """Model weights as a table (feature_id, w array): one row per feature id."""
    import pandas as pd
    pdf = pd.DataFrame({"feature_id": np.arange(len(emb), dtype="int64"), "w": [row.tolist() for row in emb.astype("float64")]})
    return spark.createDataFrame(pdf, "feature_id bigint, w array<double>")


def embedding_lookup(long: DataFrame, emb_table: DataFrame, emb_rows: int | None = None,
                     emb_width: int | None = None) -> DataFrame:
    """Gather: (key, field, feature_id, value) ⋈ (feature_id, w array): one row per (key, field).
    The weight table is broadcast only after its size is checked; beyond that, ids that many records
    hold (a numeric field's id is in all of them) keep out of the shuffle."""
    return lookup_join(long, emb_table, "feature_id", "feature_id", "inner", right_rows=emb_rows,
                       row_bytes=emb_width and 32 + 8 * emb_width)


def embedding_scaled(looked_up: DataFrame) -> DataFrame:
    """Scale each gathered embedding by its field value (array ``v``)."""
    return looked_up.withColumn("v", F.transform("w", lambda x: x * F.col("value")))


def first_order(long: DataFrame, weights: np.ndarray, key: str) -> DataFrame:
    """(key, fm1): Σ w[feature_id] · value per record, null where a value is missing. The weights
    are a table like the embeddings, not literals of the plan."""
    table = embedding_table(long.sparkSession, np.asarray(weights).reshape(-1, 1))
    met = embedding_lookup(long, table, len(weights))
    return met.groupBy(key).agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.get("w", F.lit(0)) * F.col("value"))).alias("fm1"))
