"""Training with the feature weights as a table equals training with broadcast weights."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.interact import embedding_table
from riskloom.plans import models as Mo
from riskloom.plans import sparse_train as S
from riskloom.plans import train as T
from riskloom.sources.records import SlicedRecords, sink_sliced

DIMS = Mo.Dims(feature_dim=40, field_size=4, emb_dim=3, deep_layers=(5,))


def records(spark, n=300, text=False):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        xi = [0, 1 + int(rng.integers(0, 5)), 6 + int(rng.integers(0, 30) ** 2 % 30), 36 + int(rng.integers(0, 4))]
        xv = [None if i % 11 == 0 else float(rng.normal()), 1.0, 1.0, 1.0]
        rows.append((f"LOAN-{i}" if text else i, xi, xv, float(xi[1] >= 3), i % 3))
    return spark.createDataFrame(rows, f"k {'string' if text else 'bigint'}, xi array<int>, xv array<float>, label float, fold int")


@pytest.fixture(scope="module")
def sliced(spark, tmp_path_factory):
    return SlicedRecords(spark, sink_sliced(records(spark), str(tmp_path_factory.mktemp("sliced")), "k", 6))


def start(spark, model):
    p = Mo.init_params(model, DIMS, 5)
    table = embedding_table(spark, np.column_stack([p["emb"], p["w1"]]))
    return p, table, {k: v for k, v in p.items() if k not in ("emb", "w1")}


def as_array(weights):
    rows = sorted((r["feature_id"], r["w"]) for r in weights.collect())
    return np.array([w for _, w in rows])


@pytest.mark.parametrize("model", ["deepfm", "afm", "mmoe"])
@pytest.mark.parametrize("optimizer", ["adam", "momentum"])
def test_steps_equal_the_dense_trainer(spark, sliced, model, optimizer):
    """Several steps on mini-batches that touch different ids, dropout on."""
    cfg = T.TrainConfig(model=model, optimizer=optimizer, epochs=2, steps_per_epoch=3, learning_rate=0.05,
                        dropout={"fm0": 0.3, "fm1": 0.3, "deep1": 0.3})
    p, table, dense = start(spark, model)
    whole = T.fit(sliced, sliced.records, "k", DIMS, cfg, params=p)
    by_table = S.fit_table(sliced, sliced, "k", DIMS, cfg, weights=table, dense=dense)
    w = as_array(by_table.weights())
    assert np.allclose(w[:, :-1], whole.params["emb"], rtol=1e-9, atol=1e-12)
    assert np.allclose(w[:, -1], whole.params["w1"], rtol=1e-9, atol=1e-12)
    for k, v in by_table.dense.items():
        assert np.allclose(v, whole.params[k], rtol=1e-9, atol=1e-12)
    for c in ("train_loss", "valid_loss", "valid_auc", "valid_auc_2"):
        assert np.allclose(by_table.history[c], whole.history[c], rtol=1e-9)


def test_only_touched_rows_are_written(spark, sliced):
    p, table, dense = start(spark, "deepfm")
    cfg = T.TrainConfig(learning_rate=0.05, dropout={})
    t = S.WeightTable(table, cfg)
    moments = tuple({k: np.zeros_like(v) for k, v in dense.items()} for _ in range(2))
    S.train_step(sliced, t, dense, moments, "k", DIMS, cfg, 1, 0, 0, 6)
    touched = {r[0] for r in sliced.touched_by(0, 0, 6).select("feature_id").distinct().collect()}
    assert {r["feature_id"] for r in t.parts[1].collect()} == touched and len(touched) < DIMS.feature_dim


def test_missed_steps_are_made_up_exactly():
    cfg = T.TrainConfig(learning_rate=0.1)
    rng = np.random.default_rng(1)
    w, m1, m2 = rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.random((4, 3))
    since = np.array([2, 5, 9, 9])
    want = [x.copy() for x in (w, m1, m2)]
    for i, s in enumerate(since):
        for step in range(s + 1, 2001):
            for a, b in zip(want, T.update_rule(want[0][i], 0.0, want[1][i], want[2][i], step, cfg), strict=True):
                a[i] = b
    for a, b in zip(S.missed(w, m1, m2, since, 2000, cfg), want, strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-300)


def test_a_step_reads_its_own_slices(spark, sliced):
    files = [{r[0] for r in sliced.batch(1, b, 3).select(F.input_file_name()).distinct().collect()} for b in range(3)]
    whole = {r[0] for r in sliced.records.select(F.input_file_name()).distinct().collect()}
    assert sum(map(len, files)) == len(whole) and set().union(*files) == whole
    keys = [r["k"] for b in range(3) for r in sliced.batch(1, b, 3).select("k").collect()]
    assert sorted(keys) == list(range(300))
    assert sliced.chosen(0, 0, 3) != sliced.chosen(1, 0, 3)


def test_sliced_batches_have_the_gradients_of_their_rows(spark, sliced):
    p = Mo.init_params("deepfm", DIMS, 7)
    keys = [r["k"] for r in sliced.batch(0, 1, 2).select("k").collect()]
    plain = records(spark).where(F.col("k").isin(keys))
    a = T.gradient_sum(sliced.batch(0, 1, 2), "k", "deepfm", p, DIMS, 0, 0, 0, 1, {"fm0": 0.5})
    b = T.gradient_sum(plain, "k", "deepfm", p, DIMS, 0, 0, 0, 1, {"fm0": 0.5})
    assert a[1] == b[1] == len(keys) and all(np.allclose(a[2][k], b[2][k], rtol=1e-9, atol=1e-12) for k in p)


def test_an_id_in_every_record_is_one_row_per_slice(sliced):
    n = sliced.touched.where("feature_id = 0").count()
    assert n == sliced.touched.select("fold_id", "slice").distinct().count()


@pytest.mark.parametrize("model", ["deepfm", "afm", "mmoe"])
def test_dropout_on_text_keys(spark, model):
    p = Mo.init_params(model, DIMS, 7)
    df = records(spark, 60, text=True)
    a = T.gradient_sum(df.repartition(1), "k", model, p, DIMS, 0, 0, 0, 1, {"fm0": 0.5, "deep1": 0.5})
    b = T.gradient_sum(df.repartition(3), "k", model, p, DIMS, 0, 0, 0, 1, {"fm0": 0.5, "deep1": 0.5})
    assert a[1] == 60 and all(np.allclose(a[2][k], b[2][k], rtol=1e-9, atol=1e-12) for k in p)


def test_seeded_weights_are_normal(spark):
    w = as_array(S.normal_weights(spark, 3000, 3, 1))
    assert w.shape == (3000, 4) and abs(w.mean()) < 0.005 and abs(w.std() - 0.1) < 0.005
