"""Model math: pair sum = FM second order, Spark array forms = NumPy, gradients, and
data-parallel steps that do not depend on partitioning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import interact as I
from riskloom.plans import models as Mo

from paths import SF_SMALL


def test_fm_second_order_equals_pair_sum(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", I.as_double_array("embedding").alias("e"))
    fm = e.select("vec_id", F.aggregate(I.fm_second_order(F.col("e"), 4, 16), F.lit(0.0), lambda a, x: a + x).alias("s"))
    pr = e.select("vec_id", F.aggregate(I.pair_dots(F.col("e"), 4, 16), F.lit(0.0), lambda a, x: a + x["dot"]).alias("s"))
    gap = fm.join(pr, "vec_id").select(F.max(F.abs(fm.s - pr.s))).first()[0]
    assert gap < 1e-9


def test_spark_layer_norm_matches_numpy(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").limit(20).collect()
    df = spark.createDataFrame([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in rows], "vec_id long, e array<double>")
    got = {r["vec_id"]: np.array(r["n"]) for r in I.layer_norm(df, "e", 4, 16, "n").collect()}
    for r in rows:
        x = np.asarray(r["embedding"], dtype=float).reshape(4, 16)
        assert np.allclose(got[r["vec_id"]], Mo.layer_norm(x).ravel(), atol=1e-9)


@pytest.mark.parametrize("model,mode", [("deepfm", "as_reference"), ("afm", "as_reference"),
                                        ("afm", "paper"), ("mmoe", "as_reference")])
def test_gradients_match_finite_differences(model, mode):
    rng = np.random.default_rng(0)
    d = Mo.Dims(feature_dim=20, field_size=5, emb_dim=3, deep_layers=(4, 3), num_experts=3, units=4,
                task_hidden=(2, 3), attention_mode=mode)
    p = {k: v + rng.normal(0, 0.3, np.shape(v)) for k, v in Mo.init_params(model, d, 1).items()}
    xi, xv = rng.integers(0, 20, (7, 5)), rng.normal(0, 1, (7, 5))
    y = rng.integers(0, 2, 7).astype(float)
    drop = Mo.dropout_masks(model, d, np.arange(7), 3, {"fm0": 0.5, "att": 0.5, "deep1": 0.5})
    _, g = Mo.GRAD[model](p, d, xi, xv, y, drop)
    for k, v in p.items():
        for idx in list(np.ndindex(np.shape(v)))[:4]:
            pp = {a: np.array(b, dtype=float, copy=True) for a, b in p.items()}
            pp[k][idx] += 1e-5
            lp, _ = Mo.GRAD[model](pp, d, xi, xv, y, drop)
            pp[k][idx] -= 2e-5
            lm, _ = Mo.GRAD[model](pp, d, xi, xv, y, drop)
            num = (lp - lm) / 2e-5
            assert abs(num - np.asarray(g[k])[idx]) <= 1e-5 * max(1.0, abs(num))


def test_gradient_step_partition_independent(spark):
    from riskloom.plans.train import gradient_sum
    rng = np.random.default_rng(3)
    d = Mo.Dims(feature_dim=30, field_size=4, emb_dim=3, deep_layers=(5,))
    rows = [(i, rng.integers(0, 30, 4).tolist(), rng.normal(0, 1, 4).tolist(), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, xi array<int>, xv array<float>, label float")
    p = Mo.init_params("deepfm", d, 7)
    drop = {"fm0": 0.5, "deep1": 0.5}
    l1, n1, g1 = gradient_sum(df.repartition(1), "k", "deepfm", p, d, 0, 0, 0, 1, drop)
    l4, n4, g4 = gradient_sum(df.repartition(4), "k", "deepfm", p, d, 0, 0, 0, 1, drop)
    assert n1 == n4 == 200 and abs(l1 - l4) <= 1e-9 * abs(l1)
    for k in g1:
        assert np.allclose(g1[k], g4[k], rtol=1e-9, atol=1e-12)


def test_training_loss_falls(spark):
    from riskloom.plans.train import TrainConfig, fit
    rng = np.random.default_rng(5)
    d = Mo.Dims(feature_dim=12, field_size=3, emb_dim=4, deep_layers=(8,))
    rows = []
    for i in range(600):
        xi = [rng.integers(0, 4), 4 + rng.integers(0, 4), 8 + rng.integers(0, 4)]
        rows.append((i, [int(v) for v in xi], [1.0, 1.0, 1.0], float(xi[0] >= 2)))
    df = spark.createDataFrame(rows, "k long, xi array<int>, xv array<float>, label float")
    cfg = TrainConfig(epochs=8, learning_rate=0.05, dropout={})
    res = fit(df, df, "k", d, cfg)
    h = res.history
    assert h["train_loss"].iloc[-1] < h["train_loss"].iloc[0]
    assert h["valid_auc"].iloc[-1] > 0.9


def _toy(spark, n=400):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        xi = [rng.integers(0, 4), 4 + rng.integers(0, 4), 8 + rng.integers(0, 4)]
        rows.append((i, [int(v) for v in xi], [1.0, 1.0, 1.0], float(xi[0] >= 2)))
    return spark.createDataFrame(rows, "k long, xi array<int>, xv array<float>, label float")


@pytest.mark.parametrize("model", ["deepfm", "afm", "mmoe"])
def test_evaluation_sees_the_training_loss(spark, model):
    """Same weights, same rows, no dropout: what training sums and evaluation reports agree."""
    from riskloom.plans.train import evaluate, gradient_sum
    d = Mo.Dims(feature_dim=12, field_size=3, emb_dim=4, deep_layers=(8,))
    p = Mo.parity_params(model, d)
    loss, n, _ = gradient_sum(_toy(spark), "k", model, p, d, 0, 0, 0, 1, {})
    ev = evaluate(_toy(spark), "k", model, p, d)
    assert n == ev["n"] == 400 and abs(loss / n - ev["loss"]) < 1e-9


def test_mini_batches_cut_every_row_once(spark):
    from riskloom.plans.train import mini_batch
    df = _toy(spark)
    keys = [r["k"] for b in range(3) for r in mini_batch(df, "k", 1, b, 3).select("k").collect()]
    assert sorted(keys) == list(range(400))


def test_fit_saves_weights_and_history_and_stops(spark, tmp_path):
    from riskloom.plans.train import TrainConfig, fit
    from riskloom.sources.files import load_params, read_history
    d = Mo.Dims(feature_dim=12, field_size=3, emb_dim=4, deep_layers=(8,))
    cfg = TrainConfig(model="afm", epochs=6, learning_rate=0.0, dropout={}, patience=2, min_history=2)
    # nothing is learned: the AUC never falls below its best, so the rule must not fire
    res = fit(_toy(spark), _toy(spark), "k", d, cfg, run="r", save_to=str(tmp_path / "w"), history_to=str(tmp_path / "h"))
    assert res.stopped_at is None and read_history(spark, str(tmp_path / "h")).count() == 6
    back, meta = load_params(spark, str(tmp_path / "w"))
    assert meta["model"] == "afm" and all(np.allclose(back[k], res.params[k]) for k in res.params)


def test_missing_level_and_indicator(spark):
    from riskloom.plans.tune import assemble_features
    df = spark.createDataFrame([(1.5, 0), (None, 2), (float("nan"), None)], "x double, c int")
    out, levels = assemble_features(df, ["x"], ["c"])
    assert levels == 4 and [r["features"].toArray().tolist() for r in out.collect()] == [[1.5, 0, 1], [0, 1, 3], [0, 1, 0]]


def test_afm_draws_the_masks_it_reads_and_sums_kept_pairs():
    """Masks of deep layers cost more than the rest and AFM has none; pairs that are kept are summed
    without a row of pairs, as by the pairs themselves."""
    rng = np.random.default_rng(2)
    d = Mo.Dims(feature_dim=20, field_size=5, emb_dim=3)
    rates = {"fm0": 0.5, "fm1": 0.5, "att": 0.5, "deep0": 0.5, "deep1": 0.5}
    drop = Mo.dropout_masks("afm", d, np.arange(40), 3, rates)
    assert set(drop) == {"fm0", "fm1", "att"}
    assert np.array_equal(drop["fm1"], Mo.dropout_masks("deepfm", d, np.arange(40), 3, rates)["fm1"])
    e = rng.normal(0, 1, (40, 5, 3))
    ii, jj = np.triu_indices(5, k=1)
    pairs = (drop["att"][..., None] * Mo.pair_products(e)).sum(axis=1)
    near = Mo._kept_neighbours(drop["att"], e, ii, jj)
    assert np.allclose(0.5 * (e * near).sum(axis=1), pairs, rtol=1e-12)


def test_scatter_adds_repeated_ids():
    idx, vals = np.array([[0, 2], [2, 2]]), np.arange(12.0).reshape(2, 2, 3)
    want = np.zeros((4, 3))
    np.add.at(want, idx, vals)
    assert np.array_equal(Mo._scatter((4, 3), idx, vals), want)
    assert np.array_equal(Mo._scatter((4,), idx, vals[..., 0]), want[:, 0])


def test_folds_of_a_classifier_are_fitted_side_by_side(spark):
    """Two folds must be under way at once; the predictions are those of one after the other."""
    import threading

    from pyspark.ml.classification import LogisticRegression
    from riskloom.plans.tune import mllib_cv
    df = spark.createDataFrame([(i, float(i % 7), i % 3, int(i % 7 > 3), i % 2) for i in range(80)], "k long, x double, c int, y int, fold int")
    at = (df, "k", ["x"], ["c"], "y", "fold", 2)
    met = threading.Barrier(2, timeout=30)
    both = mllib_cv(*at, lambda width: met.wait() is None or LogisticRegression(maxIter=3))
    one = mllib_cv(*at, lambda width: LogisticRegression(maxIter=3), parallelism=1)
    got, want = ({r["k"]: r["p"] for r in d.collect()} for d in (both, one))
    assert len(got) == 80 and max(abs(got[k] - want[k]) for k in want) < 1e-12
