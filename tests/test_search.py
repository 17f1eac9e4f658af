"""Network search: trials trained by shared passes equal trials trained alone."""
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from riskloom.plans import models as Mo
from riskloom.plans import search as Q
from riskloom.plans import train as T

DIMS = Mo.Dims(feature_dim=12, field_size=3, emb_dim=4, deep_layers=(8,))


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        xi = [int(rng.integers(0, 4)), 4 + int(rng.integers(0, 4)), 8 + int(rng.integers(0, 4))]
        rows.append((f"L{i}", xi, [1.0, 1.0, 1.0], float(xi[0] >= 2), i % 2))
    return spark.createDataFrame(rows, "k string, xi array<int>, xv array<float>, label float, fold int")


def trials():
    cfg = T.TrainConfig(epochs=3, steps_per_epoch=2, learning_rate=0.05, dropout={"fm0": 0.3})
    return [Q.Trial("a", DIMS, cfg), Q.Trial("b", replace(DIMS, emb_dim=2, deep_layers=(4, 4)), replace(cfg, optimizer="momentum")),
            Q.Trial("c", DIMS, replace(cfg, model="afm")), Q.Trial("d", DIMS, replace(cfg, model="mmoe", patience=1, min_history=0))]


def test_shared_passes_equal_separate_fits(records):
    train, valid = records.where("fold = 0"), records.where("fold = 1")
    history, best = Q.fit_many(train, valid, "k", trials(), 3, 2)
    for t in trials():
        alone = T.fit(train, valid, "k", t.dims, t.cfg)
        own = history[history["run"] == t.run]
        assert len(own) == len(alone.history)
        for c in ("train_loss", "valid_loss", "valid_auc"):
            assert np.allclose(own[c], alone.history[c], rtol=1e-9)
        assert Q.first_head_auc(best[t.run]) == pytest.approx(alone.history["valid_auc"].max())


def test_search_table_history_and_pooled_auc(spark, records, tmp_path):
    from riskloom.sources.files import read_history
    folds = [(records.where("fold != 0"), records.where("fold = 0")), (records.where("fold != 1"), records.where("fold = 1"))]
    cfg = T.TrainConfig(epochs=2)
    out = Q.network_search(folds, "k", DIMS, cfg, 4, 42, history_to=str(tmp_path / "h"), trials_to=str(tmp_path / "t")).toPandas()
    assert out["trial_id"].tolist() == [0, 1, 2, 3] and out["is_best"].sum() == 1
    assert out.loc[out["is_best"] == 1, "mean_auc"].item() == out["mean_auc"].max()
    assert ((out["pooled_auc"] > 0) & (out["pooled_auc"] <= 1) & (out["seconds"] > 0)).all() and (out["epochs"] == 4).all()
    again = read_history(spark, str(tmp_path / "h")).toPandas()
    assert len(again) == 4 * 2 * 2 and set(again["run"]) == {f"trial{i}-fold{j}" for i in range(4) for j in range(2)}
    assert read_history(spark, str(tmp_path / "t")).count() == 4
    for t, g in again.assign(t=again["run"].str.extract(r"trial(\d+)")[0].astype(int)).groupby("t"):
        assert out.loc[out["trial_id"] == t, "mean_auc"].item() == pytest.approx(g.groupby("run")["valid_auc"].max().mean())


def test_groups_stay_within_the_bound():
    made = trials()
    sizes = [Q.model_floats(t.params) for t in made]
    groups = Q.groups_of(made, max(sizes))
    assert [t.run for g in groups for t in g] == ["a", "b", "c", "d"]
    assert all(sum(Q.model_floats(t.params) for t in g) <= max(sizes) for g in groups)
    with pytest.raises(ValueError):
        Q.groups_of(made, 3)


def test_folds_side_by_side_equal_one_after_the_other(spark, records, tmp_path):
    from riskloom.sources.records import sink_folds, sink_sliced
    folded = records.select("k", "xi", "xv", "label", "fold")
    path = sink_folds(folded, str(tmp_path / "folds"))
    cfgs = [T.TrainConfig(model=m, epochs=2, learning_rate=0.05) for m in ("deepfm", "afm")]
    one = T.cv_by_model(spark, path, "k", DIMS, cfgs, 2, parallelism=1)
    many = T.cv_by_model(spark, path, "k", DIMS, cfgs, 2, parallelism=4, history_to=str(tmp_path / "h"))
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 8
    sliced = sink_sliced(folded, str(tmp_path / "sliced"), "k", 4)
    by_slices = T.cv_by_model(spark, path, "k", DIMS, cfgs[:1], 2, sliced=sliced)
    assert np.allclose(by_slices["valid_auc"], one["valid_auc"][:2], rtol=1e-9)


def test_a_model_above_the_bound_trains_as_a_table(spark, records, tmp_path, monkeypatch):
    from riskloom.sources.records import sink_sliced
    sliced = sink_sliced(records.select("k", "xi", "xv", "label", "fold"), str(tmp_path / "sliced"), "k", 4)
    monkeypatch.setattr(T, "MAX_MODEL_FLOATS", 40)
    out = T.cv_by_model(spark, "", "k", DIMS, [T.TrainConfig(epochs=3, learning_rate=0.05, dropout={})], 2, sliced=sliced,
                        save_to=str(tmp_path / "w"))
    assert (out["valid_auc"] > 0.5).all()
    assert spark.read.parquet(str(tmp_path / "w" / "deepfm-fold0" / "features")).count() == DIMS.feature_dim


@pytest.mark.parametrize("use_fm,use_deep", [(True, True), (True, False), (False, True)])
def test_fieldwise_passes_equal_the_models_own(use_fm, use_deep, monkeypatch):
    """Many ids and few, one id in all rows, missing values, masks of models of several widths."""
    from riskloom.plans import fieldwise as Fw
    rng = np.random.default_rng(3)
    n, made = 700, []
    xi = np.stack([np.zeros(n, int), 1 + rng.integers(0, 5, n), 6 + rng.integers(0, 200, n)], axis=1)
    xv, y, keys = np.round(rng.normal(0, 2, (n, 3)), 1), (rng.random(n) < 0.4).astype(float), rng.integers(-9, 10**12, n)
    assert (xv == 0).any()
    for emb, layers, fm0 in ((4, (8, 5), 0.3), (7, (6,), 0.6)):
        d = Mo.Dims(feature_dim=206, field_size=3, emb_dim=emb, deep_layers=layers, use_fm=use_fm, use_deep=use_deep)
        p = Mo.init_params("deepfm", d, 5)
        p["ln_scale"], p["ln_shift"] = rng.normal(1, 0.2, emb), rng.normal(0, 0.2, emb)
        made.append((p, d, {"fm0": fm0, "fm1": 0.0, "att": 0.5, "deep0": 0.5, "deep1": 0.4, "deep2": 0.2}))
    monkeypatch.setattr(Fw, "BLOCK", 256)
    plans = [Fw.mask_plan(rates, d) for _, d, rates in made]
    nets = [Fw.Net(p, d, plan, Fw.widest_masks(plans)) for (p, d, _), plan in zip(made, plans)]
    losses = [sum(x) for x in zip(*[[net.add_gradient(b) for net in nets] for b in Fw.blocks(keys, xi, xv, y, 7)])]
    for net, loss, (p, d, rates) in zip(nets, losses, made):
        want, g = Mo.deepfm_grad(p, d, xi, xv, y, Mo.dropout_masks("deepfm", d, keys, 7, rates))
        assert loss == pytest.approx(want, rel=1e-12)
        got = net.gradient()
        for k in g:
            assert np.allclose(got[k], g[k], rtol=1e-9, atol=1e-9 * np.abs(g[k]).max()), k
        scores = np.concatenate([net.scores(b) for b in Fw.blocks(keys, xi, xv, y)])
        assert np.allclose(scores, Mo.deepfm_forward(p, d, xi, xv), rtol=1e-12)


def test_dropout_hashes_and_ids_are_made_once_for_all_trials(monkeypatch):
    """Before, every trial hashed its own masks and had the whole batch pass through memory."""
    from riskloom.plans import fieldwise as Fw
    calls, fractions = [], Fw.hash_fractions
    monkeypatch.setattr(Fw, "hash_fractions", lambda *a: calls.append(a[1].size) or fractions(*a))
    d = [replace(DIMS, emb_dim=e) for e in (2, 4, 3)]
    plans = [Fw.mask_plan({"fm0": 0.3 + i / 10, "deep0": 0.5}, x) for i, x in enumerate(d)]
    nets = [Fw.Net(Mo.init_params("deepfm", x, 1), x, plan, Fw.widest_masks(plans)) for x, plan in zip(d, plans)]
    xi = np.arange(30).reshape(10, 3) % 12
    for block in Fw.blocks(np.arange(10), xi, np.ones((10, 3)), np.arange(10) % 2.0, 1):
        for net in nets:
            net.add_gradient(block)
    assert sorted(calls) == [3, 12]  # one hash for each of the two masks, of the widest model's width
