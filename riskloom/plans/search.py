"""Parameter search over networks: all trials of a fold are trained by the same passes.

A step reads a fold's records once; every task computes the gradients of all trials that still
run, and their vectors travel as one. DeepFM's trials share what their rows have in common (``fieldwise``). The objective of a trial is its mean fold AUC; the pooled AUC
beside it comes from the summed score histograms of the folds, so no prediction is written. Trials
that meet the stop rule leave the passes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.files import commit_history
from ..sources.records import SlicedRecords
from .fieldwise import Net, blocks, mask_plan, widest_masks
from .models import FORWARD, GRAD, Dims, dropout_masks, init_params, mmoe_heads
from .score import MAX_MODEL_FLOATS, model_floats
from .train import (
    AUC_BINS,
    TrainConfig,
    _apply_update,
    _flatten,
    _layout,
    _unflatten,
    mask_keyed,
    mini_batch,
    score_counts,
    should_stop,
    side_by_side,
    summed,
    task_sums,
    thresholded_auc,
    training_rows,
)
from .tune import Param, sample_trials

HIST = 4 * (AUC_BINS + 1)

# The ranges of the network's search.
NETWORK_SPACE = [
    Param("lr", "float", 0.001, 0.01),
    Param("epsilon", "float", 1e-5, 1e-1),
    Param("emb_dim", "int", 4, 16),
    Param("dropout_fm_0", "float", 0.3, 0.8),
    Param("dropout_fm_1", "float", 0.3, 0.8),
    Param("deep_layers_0", "int", 16, 32),
    Param("deep_layers_1", "int", 16, 32),
]
DROPOUT_DEEP = 0.5


@dataclass
class Trial:
    """One model in training; ``run`` names it."""
    run: str
    dims: Dims
    cfg: TrainConfig
    params: dict = None
    m1: dict = None
    m2: dict = None
    stopped: bool = False

    def __post_init__(self):
        self.params = self.params or init_params(self.cfg.model, self.dims, self.cfg.seed)
        self.m1, self.m2 = ({k: np.zeros_like(v, dtype=np.float64) for k, v in self.params.items()} for _ in range(2))


def trial_of(row: dict, dims: Dims, cfg: TrainConfig) -> Trial:
    """A sampled row of ``NETWORK_SPACE`` as a model."""
    layers = (int(row["deep_layers_0"]), int(row["deep_layers_1"]))
    drop = {"fm0": row["dropout_fm_0"], "fm1": row["dropout_fm_1"], **{f"deep{i}": DROPOUT_DEEP for i in range(len(layers) + 1)}}
    return Trial(f"trial{row['trial_id']}", replace(dims, emb_dim=int(row["emb_dim"]), deep_layers=layers),
                 replace(cfg, learning_rate=row["lr"], epsilon=row["epsilon"], dropout=drop))


def _shared(spark, trials: list[Trial]):
    ship_package(spark)
    return spark.sparkContext.broadcast([(t.cfg.model, t.params, t.dims, _layout(t.params), t.cfg.dropout) for t in trials])


def _nets(models) -> dict[int, Net]:
    """The DeepFM models of a broadcast by their places."""
    plans = {i: mask_plan(dropout, d) for i, (m, _, d, _, dropout) in enumerate(models) if m == "deepfm"}
    widest = widest_masks(list(plans.values()))
    return {i: Net(models[i][1], models[i][2], plan, widest) for i, plan in plans.items()}


def step_of_all(records: DataFrame, key: str, trials: list[Trial], step: int) -> list[tuple[float, int]]:
    """One gradient step of every trial from one pass over the records: (loss sum, rows) each.
    ``step`` counts from 0."""
    bc = _shared(records.sparkSession, trials)

    def part(batches):
        models = bc.value
        nets = _nets(models)
        total, losses, n = [0.0] * len(models), np.zeros(len(models)), 0
        for rows in batches:
            if rows.num_rows == 0:
                continue
            keys, xi, xv, y = training_rows(rows, models[0][2].field_size)
            for block in blocks(keys, xi, xv, y, step) if nets else ():
                for i, net in nets.items():
                    losses[i] += net.add_gradient(block)
            for i, (m, p, d, layout, dropout) in enumerate(models):
                if i in nets:
                    continue
                loss, g = GRAD[m](p, d, xi, xv, y, dropout_masks(m, d, keys, step, dropout))
                total[i] = total[i] + _flatten(g, layout)
                losses[i] += float(loss)
            n += len(y)
        if n:
            for i, net in nets.items():
                total[i] = _flatten(net.gradient(), models[i][3])
            yield task_sums("g", np.concatenate([losses, *total]), 0.0, n)

    row = summed(mask_keyed(records, key).mapInArrow(part, "g array<double>, loss double, n long, task int"), "g")
    bc.unpersist()
    if row is None or not row["n"]:
        return [(0.0, 0)] * len(trials)
    vector, n, out = row["g"].toArray(), int(row["n"]), []
    at = len(trials)
    for i, t in enumerate(trials):
        size = model_floats(t.params)
        g = _unflatten(vector[at:at + size], _layout(t.params))
        at += size
        t.params = _apply_update(t.params, g, n, t.m1, t.m2, step + 1, t.cfg)
        out.append((float(vector[i]), n))
    return out


def histograms_of_all(records: DataFrame, key: str, trials: list[Trial]) -> tuple[np.ndarray, np.ndarray, int]:
    """(score histograms, loss sums, rows) of every trial from one pass."""
    bc = _shared(records.sparkSession, trials)

    def part(batches):
        models = bc.value
        nets = _nets(models)
        hist, losses, n = np.zeros((len(models), HIST)), np.zeros(len(models)), 0
        for rows in batches:
            if rows.num_rows == 0:
                continue
            keys, xi, xv, y = training_rows(rows, models[0][2].field_size)
            for block in blocks(keys, xi, xv, y) if nets else ():
                for i, net in nets.items():
                    losses[i] += score_counts(hist[i], (net.scores(block),) * 2, block.y)
            for i, (m, p, d, _, _) in enumerate(models):
                if i in nets:
                    continue
                heads = mmoe_heads(p, d, xi, xv) if m == "mmoe" else (FORWARD[m](p, d, xi, xv),) * 2
                losses[i] += score_counts(hist[i], heads, y)
            n += len(y)
        if n:
            yield task_sums("h", np.concatenate([losses, hist.ravel()]), 0.0, n)

    row = summed(mask_keyed(records, key).mapInArrow(part, "h array<double>, loss double, n long, task int"), "h")
    bc.unpersist()
    if row is None or not row["n"]:
        return np.zeros((len(trials), HIST)), np.full(len(trials), np.nan), 0
    vector = row["h"].toArray()
    return vector[len(trials):].reshape(len(trials), HIST), vector[:len(trials)], int(row["n"])


def first_head_auc(hist: np.ndarray) -> float:
    neg, pos = hist[:AUC_BINS + 1], hist[AUC_BINS + 1:2 * (AUC_BINS + 1)]
    return thresholded_auc(pos, neg)


def groups_of(trials: list[Trial], most: int = MAX_MODEL_FLOATS) -> list[list[Trial]]:
    """Trials that train together: their weights stay within the broadcast bound."""
    out, room = [], 0
    for t in trials:
        size = model_floats(t.params)
        if size > most:
            raise ValueError(f"{t.run} has {size} weights, above the broadcast bound {most}")
        if not out or room < size:
            out.append([])
            room = most
        out[-1].append(t)
        room -= size
    return out


def fit_many(train: DataFrame | SlicedRecords, valid: DataFrame, key: str, trials: list[Trial], epochs: int,
             steps_per_epoch: int = 1) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """``train.fit`` of all trials side by side. Returns (history rows; by run, the histogram of the
    epoch with the best AUC). Every pass serves all trials that still run."""
    sliced = isinstance(train, SlicedRecords)
    rows, aucs, best = [], {t.run: [] for t in trials}, {}
    step = 0
    for epoch in range(epochs):
        t0, live = time.time(), [t for t in trials if not t.stopped]
        if not live:
            break
        loss, seen = np.zeros(len(live)), 0
        for b in range(steps_per_epoch):
            own = train.batch(epoch, b, steps_per_epoch) if sliced else mini_batch(train, key, epoch, b, steps_per_epoch)
            done = step_of_all(own, key, live, step)
            step += 1
            loss, seen = loss + [x for x, _ in done], seen + done[0][1]
        hist, valid_loss, n = histograms_of_all(valid, key, live)
        seconds = time.time() - t0
        for i, t in enumerate(live):
            auc = first_head_auc(hist[i])
            if not aucs[t.run] or auc > max(aucs[t.run]):
                best[t.run] = hist[i]
            aucs[t.run].append(auc)
            rows.append({"run": t.run, "epoch": epoch, "train_loss": loss[i] / max(seen, 1), "valid_loss": valid_loss[i] / max(n, 1),
                         "valid_auc": auc, "seconds": seconds / len(live)})
            t.stopped = should_stop(aucs[t.run], t.cfg.patience, t.cfg.min_history)
    return pd.DataFrame(rows), best


def network_search(folds: list[tuple[DataFrame | SlicedRecords, DataFrame]], key: str, dims: Dims, cfg: TrainConfig,
                   n_trials: int, seed: int, space=None, make=trial_of, history_to: str | None = None,
                   trials_to: str | None = None, parallelism: int = 3) -> DataFrame:
    """Sampled trials over all (train, valid) folds: a row per trial with its parameters, mean and
    pooled AUC, best epochs, seconds, and whether it is the best. ``history_to`` and ``trials_to``:
    history tables, committed by run and epoch, and by trial."""
    first = folds[0][1]
    spark = first.sparkSession
    sampled = [r.asDict() for r in sample_trials(spark, space or NETWORK_SPACE, n_trials, seed).orderBy("trial_id").collect()]

    def job(i: int):
        done = [fit_many(*folds[i], key, group, cfg.epochs, cfg.steps_per_epoch)
                for group in groups_of([make(r, dims, cfg) for r in sampled])]
        return pd.concat([h for h, _ in done]), {k: v for _, best in done for k, v in best.items()}

    results = side_by_side(spark, [lambda i=i: job(i) for i in range(len(folds))], parallelism)
    rows = []
    for r in sampled:
        run = f"trial{r['trial_id']}"
        own = [h[h["run"] == run] for h, _ in results]
        rows.append({**r, "mean_auc": float(np.mean([h["valid_auc"].max() for h in own])),
                     "pooled_auc": first_head_auc(sum(best[run] for _, best in results)),
                     "epochs": int(sum(len(h) for h in own)), "seconds": float(sum(h["seconds"].sum() for h in own))})
    top = max(range(len(rows)), key=lambda i: (rows[i]["mean_auc"], -i))
    table = spark.createDataFrame([{**r, "is_best": int(i == top)} for i, r in enumerate(rows)])
    if history_to:
        history = pd.concat([h.assign(run=h["run"] + f"-fold{i}") for i, (h, _) in enumerate(results)])
        commit_history(spark.createDataFrame(history), history_to)
    if trials_to:
        commit_history(table, trials_to, ("trial_id",))
    return table
