"""Training with the feature weights as a table, for models of any number of features.

The weights of feature ids (embedding and first-order weight) and their optimizer moments are rows
``(feature_id, w, m1, m2, step)`` of a Parquet table; only the dense layers are broadcast. A step

1. reads its slices' records and the distinct ids of every slice (one row per slice and id, so an
   id that is in every record is not a hot key);
2. joins those ids with the newest rows of the table and hands each slice its weights;
3. computes the slices' gradients in NumPy: one (feature_id, gradient) row per slice and id, and
   the dense layers' sums, which alone reach the driver;
4. sums the gradients by id and appends the touched rows' new weights and moments to the table.

Adam also moves weights whose gradient is zero, by their old moments. An untouched row keeps the
step it was last written at, and the steps it missed are made up for when it is read again, so the
result is that of the dense trainer at every step. The appended rows are merged once an epoch.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join, materialize, sized_join
from ..session import ship_package
from ..sources.files import commit_history, save_params
from ..sources.records import SlicedRecords
from .models import FORWARD, GRAD, Dims, dropout_masks, init_params, mmoe_heads
from .score import _check_size
from .train import (
    AUC_BINS,
    TrainConfig,
    _apply_update,
    _flatten,
    _layout,
    _unflatten,
    epoch_metrics,
    mask_keyed,
    score_counts,
    should_stop,
    summed,
    training_rows,
    update_rule,
)

CHUNK = 8_192  # records whose gradients are computed at a time
FORGOTTEN = 1e-40  # share of a first moment below which a missed step changes nothing
TABLE = "feature_id bigint, w array<double>, m1 array<double>, m2 array<double>, step int"


# ------------------------------------------------------------------ the table
def normal_weights(spark: SparkSession, feature_dim: int, emb_dim: int, seed: int, scale: float = 0.1) -> DataFrame:
    """(feature_id, w): seeded normal weights from hashes, made by the executors."""
    def u(k, salt):
        h = F.shiftrightunsigned(F.xxhash64("feature_id", F.lit(k), F.lit(seed), F.lit(salt)), 11)
        return (h.cast("double") + 0.5) / float(1 << 53)

    z = [F.sqrt(-2.0 * F.log(u(k, 1))) * F.cos(2.0 * np.pi * u(k, 2)) * scale for k in range(emb_dim + 1)]
    return spark.range(feature_dim).withColumnRenamed("id", "feature_id").select("feature_id", F.array(*z).alias("w"))


def formula_weights(spark: SparkSession, feature_dim: int, emb, w1, emb_dim: int) -> DataFrame:
    """(feature_id, w) from functions of the id and the embedding's entry."""
    i = F.col("feature_id")
    return spark.range(feature_dim).select(F.col("id").alias("feature_id")).select(
        "feature_id", F.array(*[emb(i, F.lit(k)) for k in range(emb_dim)], w1(i)).alias("w"))


class WeightTable:
    """The newest rows of a base table and of the rows that later steps appended."""

    def __init__(self, weights: DataFrame, cfg: TrainConfig):
        zero = F.transform("w", lambda x: F.lit(0.0))
        self.cfg = cfg
        self.parts = [materialize(weights.select("feature_id", "w", zero.alias("m1"), zero.alias("m2"), F.lit(0).alias("step")))]

    def read(self, step: int, ids: DataFrame | None = None) -> DataFrame:
        """Rows (of ``ids`` only) as they are before step ``step``."""
        parts = [p if ids is None else sized_join(p, ids, "feature_id", "left_semi") for p in self.parts]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if len(parts) > 1:
            rows = rows.groupBy("feature_id").agg(F.max_by(F.struct("w", "m1", "m2", "step"), "step").alias("r")).select("feature_id", "r.*")
        return caught_up(rows, step - 1, self.cfg)

    def append(self, rows: DataFrame) -> None:
        self.parts.append(materialize(rows))

    def merge(self, step: int) -> None:
        """One table again, with every row as it is before step ``step``."""
        self.parts = [materialize(self.read(step))]

    def weights(self, step: int) -> DataFrame:
        return self.read(step).select("feature_id", "w")


def _matrix(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    values = batch.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def missed(w, m1, m2, since, until: int, cfg: TrainConfig):
    """Rows last written at step ``since`` brought to ``until`` by steps without a gradient."""
    decay = cfg.beta1 if cfg.optimizer == "adam" else cfg.momentum
    lasting = int(np.ceil(np.log(FORGOTTEN) / np.log(decay))) if 0 < decay < 1 else 1
    live = np.flatnonzero((since < until) & (m1 != 0).any(axis=1))
    for k in range(1, lasting + 1):
        live = live[since[live] + k <= until]
        if not len(live):
            break
        w[live], m1[live], m2[live] = update_rule(w[live], 0.0, m1[live], m2[live], (since[live] + k)[:, None], cfg)
    left = np.maximum(0, until - since - lasting)[:, None].astype(np.float64)  # moments alone
    if left.any():
        m1, m2 = (m1 * decay ** left, m2 * cfg.beta2 ** left) if cfg.optimizer == "adam" else (m1 * decay ** left, m2)
    # rows without a first moment are not in the loop: their second one is zero too
    return w, m1, m2


def caught_up(rows: DataFrame, until: int, cfg: TrainConfig) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            since = b.column("step").to_numpy(zero_copy_only=False).astype(np.int64)
            w, m1, m2 = missed(_matrix(b, "w"), _matrix(b, "m1"), _matrix(b, "m2"), since, until, cfg)
            yield pa.RecordBatch.from_arrays([b.column("feature_id"), _lists(w), _lists(m1), _lists(m2),
                                              pa.array(np.full(len(w), until), pa.int32())], names=["feature_id", "w", "m1", "m2", "step"])

    return rows.select("feature_id", "w", "m1", "m2", "step").mapInArrow(run, TABLE)


# ------------------------------------------------------------------ one step
def gathered(records: DataFrame, touched: DataFrame, current: DataFrame, key: str):
    """Slices' records beside their weights (one row per slice and id)."""
    unit = F.xxhash64("fold_id", "slice")
    rows = mask_keyed(records.withColumn("_unit", unit), key, "_unit")
    weights = lookup_join(touched.select(unit.alias("_unit"), "feature_id"), current.select("feature_id", "w"), "feature_id", "feature_id", "inner")
    return rows.groupBy("_unit").cogroup(weights.groupBy("_unit"))


def _local(records, weights, shared, d: Dims):
    """(parameters of the slice's own ids, ids, and pieces of its records with ids as positions)."""
    ids = weights.column("feature_id").to_numpy()
    order = np.argsort(ids)
    ids, w = ids[order], _matrix(weights, "w")[order]
    params = {**shared, "emb": w[:, :-1], "w1": w[:, -1]}

    def pieces():
        for batch in records.to_batches(max_chunksize=CHUNK):
            keys, xi, xv, y = training_rows(batch, d.field_size)
            yield keys, np.searchsorted(ids, xi), xv, y

    return params, ids, pieces()


def sparse_gradients(records: DataFrame, touched: DataFrame, current: DataFrame, key: str, model: str, dense: dict,
                     dims: Dims, step: int, dropout: dict):
    """(loss sum, row count, dense gradient sums, table (feature_id, g) of gradient sums)."""
    spark = records.sparkSession
    ship_package(spark)
    layout = _layout(dense)
    bc = spark.sparkContext.broadcast((model, dense, dims, layout))

    def run(rows, weights):
        m, shared, d, lay = bc.value
        empty = pa.table({"feature_id": pa.array([], pa.int64()), "g": pa.array([], pa.list_(pa.float64())),
                          "loss": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        if not rows.num_rows:
            return empty
        params, ids, pieces = _local(rows, weights, shared, d)
        total, vector, loss, n = np.zeros((len(ids), params["emb"].shape[1] + 1)), 0.0, 0.0, 0
        for keys, xi, xv, y in pieces:
            part, g = GRAD[m](params, d, xi, xv, y, dropout_masks(m, d, keys, step, dropout))
            total += np.column_stack([g["emb"], g["w1"]])
            vector = vector + _flatten(g, lay)
            loss, n = loss + float(part), n + len(y)
        found = pa.table({"feature_id": pa.array(ids), "g": _lists(total), "loss": pa.nulls(len(ids), pa.float64()), "n": pa.nulls(len(ids), pa.int64())})
        own = pa.table({"feature_id": pa.array([-1], pa.int64()), "g": pa.array([vector], pa.list_(pa.float64())),
                        "loss": pa.array([loss], pa.float64()), "n": pa.array([n], pa.int64())})
        return pa.concat_tables([found, own])

    parts = materialize(gathered(records, touched, current, key).applyInArrow(run, "feature_id bigint, g array<double>, loss double, n bigint"))
    sums = summed(parts.where("feature_id < 0").withColumn("task", F.xxhash64("g", "loss")), "g")
    bc.unpersist()
    if sums is None or not sums["n"]:
        return 0.0, 0, None, None
    width = dims.emb_dim + 1
    grads = parts.where("feature_id >= 0").groupBy("feature_id").agg(
        F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(width)]).alias("g"))
    return float(sums["loss"]), int(sums["n"]), _unflatten(sums["g"].toArray(), layout), grads


def updated(current: DataFrame, grads: DataFrame, n: int, step: int, cfg: TrainConfig) -> DataFrame:
    """The touched rows after step ``step``."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            w, m1, m2 = update_rule(_matrix(b, "w"), _matrix(b, "g") / n, _matrix(b, "m1"), _matrix(b, "m2"), step, cfg)
            yield pa.RecordBatch.from_arrays([b.column("feature_id"), _lists(w), _lists(m1), _lists(m2),
                                              pa.array(np.full(len(w), step), pa.int32())], names=["feature_id", "w", "m1", "m2", "step"])

    met = current.join(grads, "feature_id")  # unique on both sides
    return met.select("feature_id", "w", "m1", "m2", "g").mapInArrow(run, TABLE)


def train_step(train: SlicedRecords, table: WeightTable, dense: dict, moments: tuple[dict, dict], key: str, dims: Dims,
               cfg: TrainConfig, step: int, epoch: int = 0, batch: int = 0, n_batches: int = 1):
    """Step ``step`` (from 1) on one mini-batch: (loss sum, row count, new dense layers)."""
    touched = train.touched_by(epoch, batch, n_batches)
    current = materialize(table.read(step, touched.select("feature_id").distinct()))
    loss, n, g, grads = sparse_gradients(train.batch(epoch, batch, n_batches), touched, current, key, cfg.model, dense, dims,
                                         step - 1, cfg.dropout)
    if not n:
        return 0.0, 0, dense
    table.append(updated(current, grads, n, step, cfg))
    return loss, n, _apply_update(dense, g, n, *moments, step, cfg)


def evaluate_table(valid: SlicedRecords, weights: DataFrame, key: str, model: str, dense: dict, dims: Dims) -> dict:
    """The figures of ``train.evaluate`` with the weights joined slice by slice."""
    spark = valid.spark
    ship_package(spark)
    bc = spark.sparkContext.broadcast((model, dense, dims))

    def run(rows, weights):
        m, shared, d = bc.value
        hist, loss, n = np.zeros(4 * (AUC_BINS + 1)), 0.0, 0
        if rows.num_rows:
            params, _, pieces = _local(rows, weights, shared, d)
            for _, xi, xv, y in pieces:
                heads = mmoe_heads(params, d, xi, xv) if m == "mmoe" else (FORWARD[m](params, d, xi, xv),) * 2
                loss += score_counts(hist, heads, y)
                n += len(y)
        return pa.table({"h": pa.array([hist], pa.list_(pa.float64())), "loss": pa.array([loss], pa.float64()), "n": pa.array([n], pa.int64())})

    parts = gathered(valid.records, valid.touched, weights, key).applyInArrow(run, "h array<double>, loss double, n bigint")
    out = epoch_metrics(summed(parts.withColumn("task", F.xxhash64("h", "loss")), "h"))
    bc.unpersist()
    return out


# ------------------------------------------------------------------ the fit loop
@dataclass
class TableResult:
    table: WeightTable
    dense: dict
    history: pd.DataFrame
    stopped_at: int | None
    steps: int

    def weights(self) -> DataFrame:
        """(feature_id, w array: the embedding, then the first-order weight)."""
        return self.table.weights(self.steps + 1)


def dense_layers(model: str, dims: Dims, seed: int) -> dict:
    """Initial dense layers: their sizes do not depend on the number of features."""
    from dataclasses import replace
    return {k: v for k, v in init_params(model, replace(dims, feature_dim=1), seed).items() if k not in ("emb", "w1")}


def fit_table(train: SlicedRecords, valid: SlicedRecords, key: str, dims: Dims, cfg: TrainConfig,
              weights: DataFrame | None = None, dense: dict | None = None, run: str = "run",
              save_to: str | None = None, history_to: str | None = None) -> TableResult:
    """``train.fit`` with the feature weights as a table. ``weights`` (feature_id, w) and ``dense``:
    where to start; the default is seeded. ``save_to`` gets the table and the dense layers."""
    spark = train.spark
    dense = dense if dense is not None else dense_layers(cfg.model, dims, cfg.seed)
    _check_size(dense)
    table = WeightTable(weights if weights is not None else normal_weights(spark, dims.feature_dim, dims.emb_dim, cfg.seed), cfg)
    moments = tuple({k: np.zeros_like(v, dtype=np.float64) for k, v in dense.items()} for _ in range(2))
    rows, aucs, stopped, step = [], [], None, 0
    for epoch in range(cfg.epochs):
        t0, total, seen = time.time(), 0.0, 0
        for b in range(cfg.steps_per_epoch):
            step += 1
            loss, n, dense = train_step(train, table, dense, moments, key, dims, cfg, step, epoch, b, cfg.steps_per_epoch)
            total, seen = total + loss, seen + n
        table.merge(step + 1)
        ev = evaluate_table(valid, table.weights(step + 1), key, cfg.model, dense, dims)
        aucs.append(ev["auc"])
        rows.append({"run": run, "epoch": epoch, "train_loss": total / max(seen, 1), "valid_loss": ev["loss"],
                     "valid_auc": ev["auc"], "valid_auc_2": ev["auc_2"], "seconds": time.time() - t0})
        if should_stop(aucs, cfg.patience, cfg.min_history):
            stopped = epoch
            break
    history = pd.DataFrame(rows)
    out = TableResult(table, dense, history, stopped, step)
    if save_to:
        save_params(spark, dense, {"model": cfg.model, "dims": asdict(dims)}, save_to)
        out.weights().write.mode("overwrite").parquet(f"{save_to}/features")
    if history_to and len(history):
        commit_history(spark.createDataFrame(history), history_to)
    return out
