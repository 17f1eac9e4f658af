"""Batch scoring: encoded records → score, vectorised per Arrow batch in ``mapInArrow``.

The model (a few thousand floats) is broadcast once; every task scores its own partitions.
No shuffle, no driver round trip; the key is kept beside the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .models import FORWARD, Dims, mmoe_heads

MAX_MODEL_FLOATS = 50_000_000


def model_floats(params: dict) -> int:
    return sum(np.asarray(v).size for v in params.values())


def _check_size(params: dict) -> None:
    n = model_floats(params)
    if n > MAX_MODEL_FLOATS:
        raise ValueError(f"model has {n} weights, above the broadcast bound {MAX_MODEL_FLOATS}")


def arrow_records(batch: pa.RecordBatch, field_size: int):
    """(xi, xv) of a batch as (rows, fields) arrays: the list columns' values are one buffer, so
    no row is touched by itself. Missing values become NaN."""
    def flat(name, dtype):
        values = batch.column(batch.schema.get_field_index(name)).flatten()
        return values.to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, field_size)

    return flat("xi", np.int64), flat("xv", np.float64)


def score_batch(encoded: DataFrame, model: str, params: dict, dims: Dims, key: str,
                out: str = "score", heads: bool = False) -> DataFrame:
    """Score ``(key, xi, xv)`` rows. ``heads=True`` (MMoE) also returns both task scores. A model
    above the broadcast bound is scored by ``score_joined``."""
    if model_floats(params) > MAX_MODEL_FLOATS and not heads:
        from ..operators.interact import embedding_table
        table = embedding_table(encoded.sparkSession, np.column_stack([params["emb"], params["w1"]]))
        return score_joined(encoded, model, {k: v for k, v in params.items() if k not in ("emb", "w1")}, table, dims, key, out)
    _check_size(params)
    spark = encoded.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast((model, params, dims))
    key_type = dict(encoded.dtypes)[key]

    def run(batches):
        m, p, d = bc.value
        fwd = FORWARD[m]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xi, xv = arrow_records(batch, d.field_size)
            res = {key: batch.column(0), out: pa.array(fwd(p, d, xi, xv))}
            if heads:
                s1, s2 = mmoe_heads(p, d, xi, xv)
                res[f"{out}_1"], res[f"{out}_2"] = pa.array(s1), pa.array(s2)
            yield pa.RecordBatch.from_pydict(res)

    schema = f"`{key}` {key_type}, `{out}` double"
    if heads:
        schema += f", `{out}_1` double, `{out}_2` double"
    scored = encoded.select(key, "xi", "xv").mapInArrow(run, schema)
    # a missing input value gives NaN in NumPy; report it as null
    cols = [c for c in scored.columns if c != key]
    return scored.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def score_joined(encoded: DataFrame, model: str, dense: dict, weights: DataFrame, dims: Dims, key: str,
                 out: str = "score") -> DataFrame:
    """The scores of ``score_batch`` for feature weights of any size: ``weights`` (feature_id, w
    array: the embedding, then the first-order weight) is looked up for the records' fields (ids
    that many records hold keep out of the shuffle), a record's fields come back together, and only
    the dense layers are broadcast. ``key`` must be unique."""
    from ..operators.encode import long_form
    from ..operators.interact import embedding_lookup
    _check_size(dense)
    spark = encoded.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast((model, dense, dims))
    met = embedding_lookup(long_form(encoded, key), weights, emb_width=dims.emb_dim + 1)
    rows = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("field", "value", "w"))).alias("r"))  # a row per field
    rows = rows.select(key, F.col("r.value").alias("xv"), F.flatten("r.w").alias("w"))

    def run(batches):
        m, p, d = bc.value
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            xv = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d.field_size)
            w = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n * d.field_size, d.emb_dim + 1)
            # the batch's own rows are its weight table
            near = {**p, "emb": w[:, :-1], "w1": w[:, -1]}
            xi = np.arange(n * d.field_size).reshape(n, d.field_size)
            yield pa.RecordBatch.from_pydict({key: batch.column(0), out: pa.array(FORWARD[m](near, d, xi, xv))})

    scored = rows.mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, `{out}` double")
    return scored.withColumn(out, F.nanvl(F.col(out), F.lit(None).cast("double")))
