"""Evaluation metrics and metric-history analysis as aggregate jobs.

Scores are first pre-aggregated to one row per distinct score (map-side combine), so a
score value shared by a third of all rows is one row after the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_buckets
from . import ordered
from .joins import materialize

LOG_LOSS_EPS = 1e-7
AUC_THRESHOLDS = 200


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def scored_only(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows with a score and a label: a missing or NaN score has no rank, so neither AUC uses it."""
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())


def missing_scores(df: DataFrame, score: str, label: str, by: list[str] | tuple = ()) -> DataFrame:
    """Rows that the AUCs leave out, beside all rows."""
    s = F.col(score).cast("double")
    out = s.isNull() | F.isnan(s) | F.col(label).isNull()
    return df.groupBy(*by).agg(F.sum(out.cast("long")).alias("missing"), F.count(F.lit(1)).alias("n"))


def _score_table(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return (scored_only(df, score, label).groupBy(*by, F.col(score).cast("double").alias("s"))
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("pos"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("neg")))


def auc_exact(df: DataFrame, score: str, label: str, by: list[str] | tuple = (),
              n_buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC (ties count half): Σ pos_s · (neg below s + ½ neg_s) / (P · N).

    Distinct scores are ranked with the bucketed ordered pass (no single-task window) over a
    staged score table; rows without a score are left out (see ``missing_scores``).
    """
    by = list(by)
    t = materialize(_score_table(df, score, label, by))
    nb = n_buckets or default_buckets(df.sparkSession)
    tb = ordered.with_quantile_bucket(t, "s", nb)
    run = ordered.running(tb, {"neg_below": ordered.Agg("sum", F.col("neg"))}, ["s"],
                          ordered.BUCKET, partition_by=by, inclusive=False, stage=False)
    agg = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(*by, (F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def threshold_counts(df: DataFrame, score: str, label: str, by: list[str] | tuple = (),
                     num_thresholds: int = AUC_THRESHOLDS) -> DataFrame:
    """(by, b, pos, neg): positive and negative rows by the bucket of ``auc_thresholded``."""
    tm1 = num_thresholds - 1
    p = F.col(score).cast("double")
    b = F.least(F.greatest(F.lit(1), F.ceil(F.round(p * tm1, 9)).cast("int")), F.lit(tm1 + 1))
    return (scored_only(df, score, label).groupBy(*by, b.alias("b"))
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("double").alias("pos"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("double").alias("neg")))


def auc_thresholded(df: DataFrame, score: str, label: str, by: list[str] | tuple = (),
                    num_thresholds: int = AUC_THRESHOLDS) -> DataFrame:
    """ROC AUC on ``num_thresholds`` evenly spaced thresholds, trapezoid rule (the streaming
    AUC of the reference's metric library, without its smoothing terms).

    A score p is above threshold j (j = 0..T-1, t_j = j/(T-1)) iff p > t_j; bucket
    b = max(1, ceil(p·(T-1))) puts it above thresholds 0..b-1. At most T rows per group
    remain after the first aggregation. Rows without a score are left out.
    """
    by = list(by)
    tm1 = num_thresholds - 1
    per_b = threshold_counts(df, score, label, by, num_thresholds)
    thr = per_b.select(*by, F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), "pos", "neg")
    counts = thr.groupBy(*by, "j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    totals = per_b.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = totals.select(*by, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(tm1))).alias("j"))
    full = grid.join(counts, [*by, "j"], "left").fillna(0.0, ["tp", "fp"])
    rates = full.select(*by, "j",
                        (F.col("tp") / F.nullif(F.col("P"), F.lit(0.0))).alias("tpr"),
                        (F.col("fp") / F.nullif(F.col("N"), F.lit(0.0))).alias("fpr"))
    w = Window.partitionBy(*by).orderBy("j")  # ≤ num_thresholds rows per group
    seg = rates.select(*by, "tpr", "fpr",
                       F.lead("tpr").over(w).alias("tpr2"), F.lead("fpr").over(w).alias("fpr2"))
    return (seg.where(F.col("tpr2").isNotNull()).groupBy(*by)
            .agg(F.sum((F.col("fpr") - F.col("fpr2")) * (F.col("tpr") + F.col("tpr2")) / 2.0)
                 .alias("auc")))


def log_loss_expr(y: Column, p: Column, eps: float = LOG_LOSS_EPS) -> Column:
    return -y * F.log(p + eps) - (1 - y) * F.log(1 - p + eps)


def log_loss(df: DataFrame, score: str, label: str, by=(), eps: float = LOG_LOSS_EPS) -> DataFrame:
    """Mean binary log loss with the metric library's epsilon inside the logs."""
    return df.groupBy(*by).agg(
        F.avg(log_loss_expr(F.col(label).cast("double"), F.col(score).cast("double"), eps))
        .alias("log_loss"))


def two_head_loss(df: DataFrame, score1: str, label1: str, score2: str, label2: str, by=(),
                  eps: float = LOG_LOSS_EPS) -> DataFrame:
    """Sum of the two heads' mean log losses (the reference gives both heads one label)."""
    l1 = F.avg(log_loss_expr(F.col(label1).cast("double"), F.col(score1).cast("double"), eps))
    l2 = F.avg(log_loss_expr(F.col(label2).cast("double"), F.col(score2).cast("double"), eps))
    return df.groupBy(*by).agg(l1.alias("loss1"), l2.alias("loss2"), (l1 + l2).alias("loss"))


def accuracy(df: DataFrame, score: str, label: str, threshold: float | None = None, by=()) -> DataFrame:
    """threshold None: share of rows whose score *equals* the label (reference behaviour);
    otherwise the share where (score > threshold) equals the label."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    hit = (s == y) if threshold is None else (F.when(s > threshold, 1.0).otherwise(0.0) == y)
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("accuracy"))


def early_stop_epoch(history: DataFrame, run: str, epoch: str, metric: str,
                     patience: int = 15, min_history: int = 15,
                     n_buckets: int | None = None) -> DataFrame:
    """First epoch (1-based count t) at which a run would stop: t > min_history and the
    last ``patience`` values are all strictly below the best so far.

    Equivalent prefix form: let r_t be the last position p ≤ t with v_p ≥ max(v_1..v_{p-1});
    the best value was last reached at r_t, so the window is all below it iff t - r_t ≥
    patience. Every step is a running aggregate in epoch order (bucketed, so one long run
    does not land in one task). Returns (run, stop_t, stop_epoch, best) for runs that stop.
    """
    nb = n_buckets or default_buckets(history.sparkSession)
    h = ordered.with_quantile_bucket(history.select(run, epoch, metric), epoch, nb)
    s1 = ordered.running(h, {"t": ordered.Agg("count", F.lit(1)),
                             "prev_best": ordered.Agg("max", F.col(metric))},
                         [epoch], ordered.BUCKET, partition_by=[run], inclusive=True)
    # v_t >= max(v_1..v_{t-1})  <=>  v_t equals the running max including itself
    s = s1.withColumn("rec", F.when(F.col(metric) >= F.col("prev_best"), F.col("t")))
    s2 = ordered.running(s, {"last_rec": ordered.Agg("max", F.col("rec"))},
                         [epoch], ordered.BUCKET, partition_by=[run], inclusive=True)
    stops = s2.where((F.col("t") > min_history) & (F.col("t") - F.col("last_rec") >= patience))
    return stops.groupBy(run).agg(
        F.min("t").alias("stop_t"),
        F.min_by(epoch, "t").alias("stop_epoch"),
        F.min_by("prev_best", "t").alias("best"))


def cv_summary(scores: DataFrame, by: list[str], fold: str, score: str, label: str) -> DataFrame:
    """Mean of per-fold AUCs beside the pooled out-of-fold AUC, per ``by`` group."""
    per_fold = auc_exact(scores, score, label, by=[*by, fold]).select(*by, "auc", F.lit(None).cast("double").alias("_all"))
    pooled = auc_exact(scores, score, label, by=by).select(*by, F.lit(None).cast("double").alias("auc"),
                                                           F.col("auc").alias("_all"))
    # one aggregate over folds + 1 rows per group; no join
    return per_fold.unionByName(pooled).groupBy(*by).agg(
        F.avg("auc").alias("mean_fold_auc"), F.count("auc").alias("folds"), F.max("_all").alias("pooled_auc"))


def best_trial(trials: DataFrame, objective: str, direction: str = "maximize",
               trial_col: str = "trial_id") -> DataFrame:
    """The best trial (ties: smallest trial id), as one row."""
    o = F.col(objective)
    key = F.struct((o if direction == "maximize" else -o).alias("o"), (-F.col(trial_col)).alias("t"))
    best = trials.agg(F.max(key).alias("k"))
    return trials.join(best.select(F.col("k.o").alias("_o"), (-F.col("k.t")).alias("_t")),
                       (F.col(trial_col) == F.col("_t"))).drop("_o", "_t")


def metric_history(history: DataFrame, run: str, epoch: str, metric: str, patience: int = 15,
                   min_history: int = 15, n_buckets: int | None = None) -> DataFrame:
    """Per run and epoch: 0-based epoch number, the metric, the best so far and whether the
    early-stop rule fires first at that epoch."""
    nb = n_buckets or default_buckets(history.sparkSession)
    h = ordered.with_quantile_bucket(history.select(run, epoch, metric), epoch, nb)
    r = ordered.running(h, {"t": ordered.Agg("count", F.lit(1)), "best": ordered.Agg("max", F.col(metric))},
                        [epoch], ordered.BUCKET, partition_by=[run])
    stops = early_stop_epoch(history, run, epoch, metric, patience, min_history, n_buckets)
    out = r.join(stops.select(run, F.col("stop_t").alias("_st")), run, "left")
    return out.select(run, (F.col("t") - 1).alias("epoch_no"), F.col(metric).alias("metric"), "best",
                      F.when(F.col("t") == F.col("_st"), 1).otherwise(0).alias("is_stop"))
