"""Registered queries: one per operator of the inventory, each over whole provided tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match the
DuckDB oracle of the same name (``plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_features, parse_date
from ..functions.maps import (PRIORITY_CLASS_MAP, WORK_YEAR_MAP, WORK_YEAR_TRAIN_FILL,
                              fill_constant, map_literal)
from ..operators import dictionary as D
from ..operators import metrics as M
from ..operators import split as S
from ..operators.align import align_common_columns, filter_label, project_unlabelled
from ..operators.scale import column_stats, scale_min_std
from ..roles import APP_ROLES
from ..sources.fixtures import app_view, loan_tables
from ..sources.tables import read_table
from .common import K, SEED, finalize
from .prepare import app_spec, backfill_all, prepare

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _aligned(spark, sf):
    t = loan_tables(spark, sf)
    return align_common_columns(t["bank"], t["internet"], t["test"], target="isDefault")


def _prepared(spark, sf, balance=True):
    t = loan_tables(spark, sf)
    return prepare(t["bank"], t["internet"], t["test"], APP_ROLES, SEED, app_spec(),
                   balance=balance)


def _scored_events(spark, sf):
    """Events as scored rows: p = value / 500, label = purchase."""
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", "user_id", (F.col("value") / 500.0).alias("p"),
                     F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"))


# ---------------------------------------------------------------- fixture and schema algebra
@query
def app_fixture(spark, sf):
    return finalize(app_view(spark, sf))


@query
def align_common_columns_q(spark, sf):
    bank, internet, _, _ = _aligned(spark, sf)
    return finalize(bank.withColumn("source", F.lit("bank"))
                    .unionByName(internet.withColumn("source", F.lit("internet"))))


@query
def project_unlabelled_q(spark, sf):
    _, _, test, _ = _aligned(spark, sf)
    return finalize(test)


@query
def filter_label_q(spark, sf):
    _, internet, _, _ = _aligned(spark, sf)
    return finalize(filter_label(internet, "isDefault", 1).select("loan_id", "total_loan", "isDefault"))


# ---------------------------------------------------------------- scalar functions
@query
def parse_date_q(spark, sf):
    ev = read_table(spark, sf, "events")
    from ..functions.dates import epoch_micros
    parsed = parse_date(F.col("ts").cast("string"))
    return finalize(ev.select("event_id", epoch_micros(parsed).alias("ts_micros")))


@query
def date_features_q(spark, sf):
    app = date_features(app_view(spark, sf).select("loan_id", "issue_date"), "issue_date")
    ev = date_features(read_table(spark, sf, "events").select(
        F.col("event_id").alias("loan_id"), F.col("ts").alias("issue_date")), "issue_date")
    return finalize(app.withColumn("src", F.lit("app"))
                    .unionByName(ev.withColumn("src", F.lit("events"))))


@query
def fill_constant_q(spark, sf):
    app = app_view(spark, sf)
    return finalize(app.select("loan_id", fill_constant("work_year", WORK_YEAR_TRAIN_FILL)
                               .alias("work_year")))


@query
def map_literal_q(spark, sf):
    app = app_view(spark, sf)
    return finalize(app.select(
        "loan_id",
        map_literal(fill_constant("work_year", WORK_YEAR_TRAIN_FILL), WORK_YEAR_MAP).alias("work_year"),
        map_literal("class_raw", PRIORITY_CLASS_MAP).alias("class_code")))


@query
def map_class_letters(spark, sf):
    """The loan classes' literal table (A to G) over a letter column; other letters give null."""
    from ..functions.maps import CLASS_MAP
    li = read_table(spark, sf, "lineitem")
    return finalize(li.select("l_orderkey", "l_linenumber", "l_returnflag",
                              map_literal("l_returnflag", CLASS_MAP).alias("class_code")))


@query
def categorical_codes(spark, sf):
    """pandas ``astype('category')`` codes: alphabetical rank of the value, null → -1."""
    app = app_view(spark, sf)
    codes = D.category_codes(app, "industry")
    return finalize(app.select("loan_id", "industry").join(codes, "industry", "left")
                    .select("loan_id", F.coalesce("code", F.lit(-1)).alias("code")))


# ---------------------------------------------------------------- dictionaries
@query
def freq_dictionary_q(spark, sf):
    bank, _, _, _ = _aligned(spark, sf)
    out = []
    for c in ("industry", "employer_type"):
        d = D.freq_dictionary(bank, c, "loan_id")
        out.append(d.select(F.lit(c).alias("field"), F.col("value").cast("string").alias("value"),
                            "code", "cnt", "first_seen"))
    return finalize(out[0].unionByName(out[1]))


@query
def apply_dictionary_q(spark, sf):
    bank, internet, _, _ = _aligned(spark, sf)
    d = D.freq_dictionary(bank, "industry", "loan_id")
    return finalize(D.apply_dictionary(internet.select("loan_id", "industry"), "industry", d))


@query
def distinct_first_seen_q(spark, sf):
    app = app_view(spark, sf)
    return finalize(D.distinct_first_seen(app, "employer_type", "loan_id"))


@query
def backfill_global(spark, sf):
    app = app_view(spark, sf).select("loan_id", "f0", "f2", "class_raw", "work_year")
    return finalize(backfill_all(app, "loan_id"))


@query
def backfill_by_key(spark, sf):
    app = app_view(spark, sf).select("loan_id", "user_id", "f0", "f2", "class_raw", "work_year")
    return finalize(backfill_all(app, "loan_id", partition_by=["user_id"]))


@query
def column_stats_q(spark, sf):
    app = app_view(spark, sf)
    return finalize(column_stats(app, ["total_loan", "f0", "f1", "f2"]))


@query
def scale_min_std_q(spark, sf):
    app = app_view(spark, sf).select("loan_id", "total_loan", "f0", "f1", "f2")
    return finalize(scale_min_std(app, ["total_loan", "f0", "f1", "f2"]))


# ---------------------------------------------------------------- cleaning plan
@query
def prepare_train(spark, sf):
    return finalize(_prepared(spark, sf, balance=False).scaled)


@query
def prepare_raw_twin(spark, sf):
    return finalize(_prepared(spark, sf, balance=False).raw)


@query
def prepare_test(spark, sf):
    return finalize(_prepared(spark, sf, balance=False).test)


@query
def undersample_balance_q(spark, sf):
    return finalize(_prepared(spark, sf).balanced.select("loan_id", "isDefault", "total_loan"))


@query
def union_classes(spark, sf):
    """Minority rows and the drawn majority rows, stacked."""
    return finalize(_prepared(spark, sf).balanced.select("loan_id", "isDefault", "f0", "industry"))


# ---------------------------------------------------------------- splitting and ordering
@query
def renumber_rows_q(spark, sf):
    _, internet, _, _ = _aligned(spark, sf)
    return finalize(S.renumber_rows(internet.select("loan_id"), "loan_id"))


@query
def stratified_kfold_q(spark, sf):
    app = app_view(spark, sf).select("loan_id", "is_default")
    return finalize(S.stratified_kfold(app, "is_default", "loan_id", K, SEED))


@query
def plain_kfold_q(spark, sf):
    app = app_view(spark, sf).select("loan_id")
    return finalize(S.plain_kfold(app, "loan_id", K, SEED))


@query
def expand_folds_q(spark, sf):
    app = app_view(spark, sf).select("loan_id", "is_default")
    folds = S.stratified_kfold(app, "is_default", "loan_id", K, SEED)
    return finalize(S.expand_folds(folds, K).select("loan_id", "split", "role"))


@query
def take_fold_q(spark, sf):
    app = app_view(spark, sf).select("loan_id", "is_default")
    folds = S.stratified_kfold(app, "is_default", "loan_id", K, SEED)
    return finalize(S.take_fold(folds, 0, "train").select("loan_id", "is_default"))


@query
def shuffle_rows_q(spark, sf):
    return finalize(S.shuffle_rows(app_view(spark, sf).select("loan_id"), "loan_id", SEED))


@query
def batch_rows_q(spark, sf):
    return finalize(S.batch_rows(app_view(spark, sf).select("loan_id"), "loan_id", 32, seed=SEED))


# ---------------------------------------------------------------- metrics
@query
def class_counts_q(spark, sf):
    return finalize(M.class_counts(app_view(spark, sf), "is_default"))


@query
def value_counts_q(spark, sf):
    return finalize(M.value_counts(app_view(spark, sf), "industry"))


@query
def auc_exact_q(spark, sf):
    return finalize(M.auc_exact(_scored_events(spark, sf), "p", "y"))


@query
def auc_exact_by_fold(spark, sf):
    ev = S.stratified_kfold(_scored_events(spark, sf), "y", "event_id", K, SEED)
    return finalize(M.auc_exact(ev, "p", "y", by=["fold"]))


@query
def auc_thresholded_q(spark, sf):
    return finalize(M.auc_thresholded(_scored_events(spark, sf), "p", "y"))


@query
def log_loss_q(spark, sf):
    app = app_view(spark, sf).select((F.col("total_loan") / 500000.0).alias("p"), "is_default")
    return finalize(M.log_loss(app, "p", "is_default"))


@query
def two_head_loss_q(spark, sf):
    lab = read_table(spark, sf, "labels").select(
        "quality", "toxic", (((F.col("doc_id") * 37) % 100 + 0.5) / 100.0).alias("p"))
    return finalize(M.two_head_loss(lab, "p", "quality", "p", "toxic"))


@query
def accuracy_exact(spark, sf):
    """Raw scores; those that reach an end of the scale are the only ones that can equal a label."""
    ev = _scored_events(spark, sf).withColumn("p", F.least(F.greatest(F.col("p") * 3 - 1, F.lit(0.0)), F.lit(1.0)))
    return finalize(M.accuracy(ev, "p", "y"))


@query
def accuracy_at(spark, sf):
    return finalize(M.accuracy(_scored_events(spark, sf), "p", "y", threshold=0.1))


@query
def cv_summary_q(spark, sf):
    ev = S.stratified_kfold(_scored_events(spark, sf), "y", "event_id", K, SEED)
    return finalize(M.cv_summary(ev.withColumn("model", F.lit("value")), ["model"], "fold", "p", "y"))


@query
def early_stop_epoch_q(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "event_id", "value")
    return finalize(M.early_stop_epoch(ev, "user_id", "event_id", "value", patience=15,
                                       min_history=15))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k.removesuffix("_q"): v for k, v in REGISTRY.items()}


@query
def fold_profile(spark, sf):
    from .flagship import fold_profile as fp
    return fp(spark, sf)


# ---------------------------------------------------------------- feature dictionary, encoding, records
def _xi_text(c="xi"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


def _xv_sum(c="xv"):
    return F.aggregate(F.col(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def _encoded(spark, sf):
    from .export import encode_table
    prep = _prepared(spark, sf, balance=False)
    enc, fd = encode_table(prep.scaled, APP_ROLES, SEED)
    return prep, enc, fd


@query
def feature_dictionary(spark, sf):
    _, _, fd = _encoded(spark, sf)
    return finalize(fd.table)


@query
def feature_dims(spark, sf):
    prep, _, fd = _encoded(spark, sf)
    return finalize(prep.scaled.agg(F.count(F.lit(1)).alias("rows_count")).select(
        F.lit(fd.feature_dim).cast("long").alias("feature_dim"),
        F.lit(fd.field_size).cast("long").alias("field_size"), "rows_count"))


@query
def encode_xi_xv_q(spark, sf):
    _, enc, _ = _encoded(spark, sf)
    return finalize(enc.select("loan_id", _xi_text().alias("xi"), _xv_sum().alias("xv_sum"), "label"))


def _exported(spark, sf):
    from ..session import shared_path
    from ..sources.records import scan_splits
    from .export import export_folds as ef
    prep = _prepared(spark, sf, balance=False)
    path = shared_path(spark, "folds")
    ex = ef(prep.scaled, APP_ROLES, K, SEED, path)
    return ex, scan_splits(spark, path, K)


@query
def export_folds(spark, sf):
    _, back = _exported(spark, sf)
    return finalize(back.select("loan_id", "role", "fold_id", _xi_text().alias("xi"),
                                _xv_sum().alias("xv_sum"), "label"))


@query
def sink_folds_q(spark, sf):
    _, back = _exported(spark, sf)
    return finalize(back.groupBy("role", "fold_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"),
        F.round(F.sum(_xv_sum()), 4).alias("xv_total"),
        F.sum(F.aggregate("xi", F.lit(0).cast("long"), lambda a, x: a + x)).alias("xi_total")))


@query
def scan_fold_q(spark, sf):
    """Both roles of every split, each by its own pruned scan."""
    from functools import reduce
    from ..sources.records import scan_fold
    ex, _ = _exported(spark, sf)
    parts = [scan_fold(spark, ex.path, role, i, ex.fd.field_size).select(
        "loan_id", F.lit(role).alias("role"), F.lit(i).alias("fold_id"), _xi_text().alias("xi"), "label")
        for role in ("train", "valid") for i in range(K)]
    return finalize(reduce(lambda a, b: a.unionByName(b), parts))


@query
def scan_unlabelled_q(spark, sf):
    from ..operators.encode import encode_xi_xv
    from ..session import shared_path
    from ..sources.records import scan_unlabelled, sink_unlabelled
    prep, _, fd = _encoded(spark, sf)
    enc_te = encode_xi_xv(prep.test, fd, "loan_id", None, SEED)
    path = sink_unlabelled(enc_te, shared_path(spark, "unlabelled"))
    back = scan_unlabelled(spark, path, "loan_id", fd.field_size)
    return finalize(back.select("loan_id", _xi_text().alias("xi"), _xv_sum().alias("xv_sum")))


@query
def impute_unknown_id(spark, sf):
    """Dictionary fitted on orders before 1996, applied to all orders: customers first seen
    later get their field's seeded smallest-or-largest id."""
    from ..operators.dictionary import fit_feature_dictionary
    from ..operators.encode import encode_xi_xv
    from ..roles import Roles
    orders = read_table(spark, sf, "orders")
    roles = Roles(numeric=("o_totalprice",),
                  ignore=("o_orderkey", "o_orderstatus", "o_orderdate"), target=None, key="o_orderkey")
    fit = orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    fd = fit_feature_dictionary(fit, roles)
    enc = encode_xi_xv(orders, fd, "o_orderkey", None, SEED)
    return finalize(enc.select("o_orderkey", _xi_text().alias("xi"), _xv_sum().alias("xv_sum")))


# ---------------------------------------------------------------- interaction blocks (embeddings table: 4 fields × 16)
EMB_FIELDS, EMB_DIM = 4, 16


def _emb(spark, sf):
    from ..operators.interact import as_double_array
    return read_table(spark, sf, "embeddings").select("vec_id", as_double_array("embedding").alias("e"))


@query
def fm_second_order(spark, sf):
    from ..operators import interact as I
    e = _emb(spark, sf)
    return finalize(e.select("vec_id", F.posexplode(I.fm_second_order(F.col("e"), EMB_FIELDS, EMB_DIM))
                             .alias("k", "fm2")))


@query
def pairwise_interactions(spark, sf):
    from ..operators import interact as I
    e = _emb(spark, sf)
    return finalize(e.select("vec_id", F.inline(I.pair_dots(F.col("e"), EMB_FIELDS, EMB_DIM))))


@query
def layer_norm(spark, sf):
    from ..operators import interact as I
    from .models import f_ln_scale, f_ln_shift
    import numpy as np
    ks = np.arange(EMB_DIM)
    e = I.layer_norm(_emb(spark, sf), "e", EMB_FIELDS, EMB_DIM, "n", f_ln_scale(ks), f_ln_shift(ks))
    out = e.select("vec_id", F.posexplode("n").alias("pos", "v"))
    return finalize(out.select("vec_id", (F.col("pos") / EMB_DIM).cast("int").alias("f"),
                               (F.col("pos") % EMB_DIM).alias("k"), "v"))


@query
def attention_pool(spark, sf):
    from ..operators import interact as I
    from .models import f_att_h, f_bias, f_dense
    import numpy as np
    T = 4
    W = np.array([[f_dense(10, k, t) for t in range(T)] for k in range(EMB_DIM)])
    b = np.array([f_bias(10, t) for t in range(T)])
    h = np.array([f_att_h(t) for t in range(T)])
    e = _emb(spark, sf)
    e = I.attention_pool(e, "e", EMB_FIELDS, EMB_DIM, "r", "as_reference")
    e = I.attention_pool(e, "e", EMB_FIELDS, EMB_DIM, "p", "paper", W, b, h)
    out = e.select("vec_id", F.posexplode(F.arrays_zip("r", "p")).alias("k", "z"))
    return finalize(out.select("vec_id", "k", F.col("z.r").alias("afm_ref"), F.col("z.p").alias("afm_paper")))


@query
def dense_layer(spark, sf):
    from ..operators import interact as I
    from .models import f_bias, f_dense
    import numpy as np
    W = np.array([[f_dense(5, d, u) for u in range(4)] for d in range(EMB_FIELDS * EMB_DIM)])
    b = np.array([f_bias(5, u) for u in range(4)])
    e = _emb(spark, sf)
    return finalize(e.select("vec_id", F.posexplode(I.dense(F.col("e"), W, b, "relu")).alias("u", "y")))


@query
def softmax_gate(spark, sf):
    from ..operators import interact as I
    from .models import f_bias, f_dense
    import numpy as np
    W = np.array([[f_dense(31, d, x) for x in range(4)] for d in range(EMB_FIELDS * EMB_DIM)])
    b = np.array([f_bias(31, x) for x in range(4)])
    e = _emb(spark, sf)
    return finalize(e.select("vec_id", F.posexplode(I.softmax_gate(F.col("e"), W, b)).alias("expert", "gate")))


# ---------------------------------------------------------------- encoded records: gather, first order, scores
def _model_inputs(spark, sf, model, test=False):
    from .models import Dims, parity_params
    prep, enc, fd = _encoded(spark, sf)
    if test:
        from ..operators.encode import encode_xi_xv
        enc = encode_xi_xv(prep.test, fd, "loan_id", None, SEED)
    dims = Dims(feature_dim=fd.feature_dim, field_size=fd.field_size)
    return enc, dims, parity_params(model, dims)


@query
def embedding_lookup(spark, sf):
    from ..operators import interact as I
    from ..operators.encode import long_form
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    emb = I.embedding_table(spark, p["emb"])
    looked = I.embedding_lookup(long_form(enc, "loan_id"), emb, emb_rows=len(p["emb"]))
    return finalize(looked.select("loan_id", "field", "feature_id", F.posexplode("w").alias("k", "w")))


@query
def embedding_scaled(spark, sf):
    from ..operators import interact as I
    from ..operators.encode import long_form
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    emb = I.embedding_table(spark, p["emb"])
    looked = I.embedding_scaled(I.embedding_lookup(long_form(enc, "loan_id"), emb, emb_rows=len(p["emb"])))
    return finalize(looked.select("loan_id", "field", F.posexplode("v").alias("k", "v")))


@query
def fm_first_order(spark, sf):
    from ..operators import interact as I
    from ..operators.encode import long_form
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    return finalize(I.first_order(long_form(enc, "loan_id"), p["w1"], "loan_id"))


def _scored(spark, sf, model, test=False, heads=False):
    from .score import score_batch
    enc, dims, p = _model_inputs(spark, sf, model, test)
    return finalize(score_batch(enc, model, p, dims, "loan_id", heads=heads))


@query
def score_deepfm(spark, sf):
    return _scored(spark, sf, "deepfm")


def _scored_part(spark, sf, **switches):
    """DeepFM with one of its branches alone."""
    from dataclasses import replace

    from .models import parity_params
    from .score import score_batch
    enc, dims, _ = _model_inputs(spark, sf, "deepfm")
    dims = replace(dims, **switches)
    return finalize(score_batch(enc, "deepfm", parity_params("deepfm", dims), dims, "loan_id"))


@query
def score_fm_only(spark, sf):
    return _scored_part(spark, sf, use_deep=False)


@query
def score_deep_only(spark, sf):
    return _scored_part(spark, sf, use_fm=False)


@query
def score_deepfm_joined(spark, sf):
    """The same scores with the feature weights joined instead of broadcast."""
    from . import models
    from .score import score_joined
    from .sparse_train import formula_weights
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    table = formula_weights(spark, dims.feature_dim, models.f_emb, models.f_w1, dims.emb_dim)
    dense = {k: v for k, v in p.items() if k not in ("emb", "w1")}
    return finalize(score_joined(enc, "deepfm", dense, table, dims, "loan_id"))


@query
def score_afm(spark, sf):
    return _scored(spark, sf, "afm")


@query
def score_mmoe(spark, sf):
    return _scored(spark, sf, "mmoe", heads=True)


@query
def score_batch(spark, sf):
    """Unlabelled test table, encoded with the train dictionary, scored by DeepFM."""
    return _scored(spark, sf, "deepfm", test=True)


# ---------------------------------------------------------------- sources / sinks round trips
@query
def scan_csv(spark, sf):
    from ..session import shared_path
    from ..sources.files import scan_csv as read_csv, write_csv
    app = app_view(spark, sf)
    path = write_csv(app, shared_path(spark, "app-csv"))
    return finalize(read_csv(spark, path, app.schema))


@query
def scan_clean_bundle(spark, sf):
    from functools import reduce
    from ..session import shared_path
    from ..sources.files import scan_clean_bundle as read_bundle, write_bundle
    prep = _prepared(spark, sf, balance=False)
    paths = write_bundle({"scaled": prep.scaled, "raw": prep.raw, "test": prep.test},
                         shared_path(spark, "bundle"))
    tabs = read_bundle(spark, paths)
    parts = [t.select("loan_id", "total_loan", "f0", "industry", F.lit(name).alias("role")) for name, t in tabs.items()]
    return finalize(reduce(lambda a, b: a.unionByName(b), parts))


@query
def metrics_history(spark, sf):
    from ..session import shared_path
    from ..sources.files import append_history, read_history
    ev = read_table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id",
                                               F.col("value").alias("auc"))
    hist = M.metric_history(ev, "run", "event_id", "auc")
    path = append_history(hist, shared_path(spark, "history"))
    return finalize(read_history(spark, path))


@query
def model_roundtrip(spark, sf):
    from dataclasses import asdict
    from ..session import shared_path
    from ..sources.files import load_params, save_params
    from .models import Dims
    from .score import score_batch as sb
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    path = save_params(spark, p, {"model": "deepfm", "dims": asdict(dims)}, shared_path(spark, "model"))
    p2, meta = load_params(spark, path)
    d2 = Dims(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["dims"].items()})
    return finalize(sb(enc, meta["model"], p2, d2, "loan_id"))


@query
def apply_columns(spark, sf):
    from ..operators.scale import apply_columns as ac
    app = app_view(spark, sf).select("loan_id", "total_loan", "f0", "f2")
    return finalize(ac(app, ["total_loan", "f0", "f2"], lambda c, _: F.log1p(F.abs(c))))


@query
def oof_assemble(spark, sf):
    """Each fold's predictions (label means of the other folds) scattered back onto all rows."""
    from ..operators import assemble
    from ..operators.joins import materialize
    app = app_view(spark, sf).select("loan_id", "industry", "is_default")
    folds = S.stratified_kfold(app, "is_default", "loan_id", K, SEED)
    means = materialize(assemble.target_mean_oof(folds, "loan_id", "industry", "is_default", "fold", K).select("loan_id", "fold", "oof"))
    per_fold = [means.where(F.col("fold") == i).select("loan_id", F.col("oof").alias("pred")) for i in range(K)]
    return finalize(assemble.oof_assemble(per_fold, means.select("loan_id", "fold"), "loan_id"))


@query
def sample_trials(spark, sf):
    from .tune import scored_trials
    return finalize(scored_trials(_scored_events(spark, sf), "p", "y", 20, SEED))


@query
def best_trial(spark, sf):
    from .tune import scored_trials
    return finalize(M.best_trial(scored_trials(_scored_events(spark, sf), "p", "y", 20, SEED), "objective"))


# ---------------------------------------------------------------- training and search (no SQL oracle)
def _folded_records(spark, sf):
    from ..operators.joins import materialize
    prep, enc, fd = _encoded(spark, sf)
    return prep, materialize(S.stratified_kfold(enc, "label", "loan_id", K, SEED)), fd



def _training(spark, sf, models, epochs, **cfg):
    """(per-fold rows, history table) of the models, trained on every split of exported records."""
    from ..session import shared_path
    from ..sources.files import read_history
    from .models import Dims
    from .train import TrainConfig
    from .train import cv_by_model as cvm
    ex, _ = _exported(spark, sf)
    dims = Dims(feature_dim=ex.fd.feature_dim, field_size=ex.fd.field_size)
    cfgs = [TrainConfig(model=m, epochs=epochs, learning_rate=0.01, **cfg) for m in models]
    path = shared_path(spark, "history")
    rows = cvm(spark, ex.path, "loan_id", dims, cfgs, K, save_to=shared_path(spark, "weights"), history_to=path)
    return rows, read_history(spark, path)


def _train_one(spark, sf, model):
    _, history = _training(spark, sf, [model], 3, steps_per_epoch=2)
    return finalize(history.drop("seconds"))


@query
def train_deepfm(spark, sf):
    return _train_one(spark, sf, "deepfm")


@query
def train_afm(spark, sf):
    return _train_one(spark, sf, "afm")


@query
def train_mmoe(spark, sf):
    return _train_one(spark, sf, "mmoe")


@query
def cv_by_model(spark, sf):
    """All three networks on all folds, with a stop rule short enough to fire."""
    rows, _ = _training(spark, sf, ["deepfm", "afm", "mmoe"], 4, patience=2, min_history=2)
    return finalize(spark.createDataFrame(rows))


@query
def gradient_step_deepfm(spark, sf):
    """Loss, rows and the gradient of the output bias and of every first-order weight over all
    records, at the formula weights, without dropout."""
    import pandas as pd

    from .train import gradient_sum
    enc, dims, p = _model_inputs(spark, sf, "deepfm")
    loss, n, g = gradient_sum(enc, "loan_id", "deepfm", p, dims, 0, 0, 0, 1, {})
    rows = [("loss", -1, loss), ("rows", -1, float(n)), ("bout", -1, float(g["bout"]))]
    rows += [("w1", i, float(v)) for i, v in enumerate(g["w1"])]
    return finalize(spark.createDataFrame(pd.DataFrame(rows, columns=["name", "i", "value"])), 4)


@query
def gradient_step_sparse(spark, sf):
    """All feature weights after one step of plain gradient descent (rate 1) over all records, kept as
    a table: AFM's embeddings (k 0 to 7) and first order (k 8), and DeepFM's first order."""
    import numpy as np

    from ..session import shared_path
    from ..sources.records import SlicedRecords, sink_sliced
    from . import models
    from .sparse_train import WeightTable, formula_weights, train_step
    from .train import TrainConfig
    enc, dims, _ = _model_inputs(spark, sf, "deepfm")
    path = sink_sliced(enc.withColumn("fold", F.lit(0)), shared_path(spark, "sliced"), "loan_id", 16)
    rows, out = SlicedRecords(spark, path), []
    for model in ("afm", "deepfm"):
        dense = {k: v for k, v in models.parity_params(model, dims).items() if k not in ("emb", "w1")}
        cfg = TrainConfig(model=model, optimizer="momentum", learning_rate=1.0, dropout={})
        table = WeightTable(formula_weights(spark, dims.feature_dim, models.f_emb, models.f_w1, dims.emb_dim), cfg)
        train_step(rows, table, dense, tuple({k: np.zeros_like(v) for k, v in dense.items()} for _ in range(2)),
                   "loan_id", dims, cfg, 1)
        out.append(table.weights(2).select(F.lit(model).alias("model"), "feature_id", F.posexplode("w").alias("k", "w")))
    return finalize(out[0].unionByName(out[1].where(F.col("k") == dims.emb_dim)))


@query
def mmoe_head_metrics(spark, sf):
    """Both heads' loss and AUC at the formula weights: evaluation sees what training minimises."""
    import pandas as pd

    from .train import evaluate
    enc, dims, p = _model_inputs(spark, sf, "mmoe")
    ev = evaluate(enc, "loan_id", "mmoe", p, dims)
    return finalize(spark.createDataFrame(pd.DataFrame([ev])))


@query
def auc_with_missing_scores(spark, sf):
    """Scores missing by key arithmetic (null) or NaN: both AUCs leave them out, and they are counted."""
    from functools import reduce
    ev = _scored_events(spark, sf).withColumn(
        "p", F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double"))
        .when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p")))
    exact = M.auc_exact(ev, "p", "y").withColumnRenamed("auc", "auc_exact")
    steps = M.auc_thresholded(ev, "p", "y").withColumnRenamed("auc", "auc_thresholded")
    parts = [("auc_exact", exact), ("auc_thresholded", steps), ("missing", M.missing_scores(ev, "p", "y").select("missing"))]
    return finalize(reduce(lambda a, b: a.unionByName(b), [
        d.select(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n, d in parts]))


def _app_with_nan(spark, sf):
    app = app_view(spark, sf).select("loan_id", "total_loan", "f0", "f1", "f2")
    nan = F.lit(float("nan"))
    return app.withColumns({"total_loan": F.when(F.col("loan_id") % 7 == 0, nan).otherwise(F.col("total_loan")),
                            "f0": F.when(F.col("loan_id") % 11 == 0, nan).otherwise(F.col("f0"))})


@query
def scale_with_nan(spark, sf):
    """NaN is a missing value: it stays missing and leaves the column's statistics alone."""
    return finalize(scale_min_std(_app_with_nan(spark, sf), ["total_loan", "f0", "f1", "f2"]))


@query
def backfill_with_nan(spark, sf):
    return finalize(backfill_all(_app_with_nan(spark, sf), "loan_id"))


@query
def renumber_text_keys(spark, sf):
    """Row numbers in the order of a text key."""
    li = read_table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_key"))
    return finalize(S.renumber_rows(li, "line_key"))


def _mllib_frame(spark, sf):
    prep = _prepared(spark, sf, balance=False)
    used = APP_ROLES.used(prep.scaled.columns)
    numeric = [c for c in used if APP_ROLES.kind(c) == "numeric"]
    folded = S.stratified_kfold(prep.scaled, "isDefault", "loan_id", K, SEED)
    return folded, numeric, [c for c in used if c not in numeric]


def _gbt(spark, sf, **limits):
    from .boost import BoostConfig, boost_cv
    folded, numeric, cats = _mllib_frame(spark, sf)
    return boost_cv(folded, "loan_id", numeric, cats, "isDefault", "fold", K,
                    BoostConfig(max_depth=4, max_bins=32, learning_rate=0.1, seed=SEED, **limits))


@query
def train_gbt_cv(spark, sf):
    """Up to 10,000 rounds per fold, until 200 brought no better AUC (the reference's limits)."""
    return finalize(_gbt(spark, sf)[0])


@query
def oof_predictions_once(spark, sf):
    """Every labelled row is predicted exactly once, by the model of its own fold; scores are
    probabilities (the invariant of the out-of-fold assembly, over trained trees, however many)."""
    _, oof = _gbt(spark, sf, rounds=20, patience=5)
    return finalize(oof.groupBy("loan_id", "fold").agg(
        F.count(F.lit(1)).alias("times"), F.max("label").alias("label"),
        F.min(((F.col("p") >= 0) & (F.col("p") <= 1)).cast("int")).alias("is_probability")))


def _mllib(spark, sf, make):
    from .tune import mllib_cv
    folded, numeric, cats = _mllib_frame(spark, sf)
    oof = mllib_cv(folded, "loan_id", numeric, cats, "isDefault", "fold", K, make)
    return finalize(M.auc_exact(oof, "p", "label", by=["fold"]))


@query
def network_search(spark, sf):
    """20 sampled DeepFM settings on all folds, trained by the same passes: parameters, mean and
    pooled AUC and the best, read back from the trial table."""
    from ..session import shared_path
    from ..sources.files import read_history
    from ..sources.records import scan_fold
    from .models import Dims
    from .search import network_search as search
    from .train import TrainConfig
    ex, _ = _exported(spark, sf)
    dims = Dims(feature_dim=ex.fd.feature_dim, field_size=ex.fd.field_size)
    folds = [tuple(scan_fold(spark, ex.path, role, i, ex.fd.field_size) for role in ("train", "valid")) for i in range(K)]
    path = shared_path(spark, "trials")
    search(folds, "loan_id", dims, TrainConfig(epochs=3, steps_per_epoch=2), 20, SEED, trials_to=path)
    return finalize(read_history(spark, path).drop("seconds"))


@query
def train_fm(spark, sf):
    from pyspark.ml.classification import FMClassifier
    return _mllib(spark, sf, lambda width: FMClassifier(factorSize=8, maxIter=20, seed=SEED))


@query
def train_mlp(spark, sf):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    return _mllib(spark, sf, lambda width: MultilayerPerceptronClassifier(layers=[width, 32, 32, 2], maxIter=20, seed=SEED))


@query
def saved_scorers(spark, sf):
    """Trees, factorization machine and perceptron of every fold, saved with their encoders, found in the
    registry and loaded: how often each row is scored again from its plain columns by the model that did
    not see it, and whether that score is the one of the training run."""
    from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier

    from ..operators.joins import materialize
    from ..session import shared_path
    from .boost import BoostConfig, boost_cv
    from .saved import KEYS, load_scorer, registered
    from .tune import mllib_cv
    folded, numeric, cats = _mllib_frame(spark, sf)
    folded = materialize(folded)
    root = shared_path(spark, "registry")
    at = ("loan_id", numeric, cats, "isDefault", "fold", K)
    oof = {
        # fewer bins than some category has levels, so label means are saved too
        "trees": boost_cv(folded, *at, BoostConfig(rounds=4, patience=4, max_depth=3, max_bins=16, seed=SEED), registry=root)[1],
        "fm": mllib_cv(folded, *at, lambda width: FMClassifier(factorSize=4, maxIter=3, seed=SEED), "fm", root),
        "mlp": mllib_cv(folded, *at, lambda width: MultilayerPerceptronClassifier(layers=[width, 8, 2], maxIter=3, seed=SEED), "mlp", root),
    }
    out = []
    for r in registered(spark, root).orderBy(*KEYS).collect():  # a row per model
        rows = folded.where(F.col("fold") == r["fold"]).select("loan_id", *numeric, *cats)
        again = load_scorer(spark, root, *[r[k] for k in KEYS]).score(rows, "again")
        out.append(oof[r["kind"]].where(F.col("fold") == r["fold"]).select("loan_id", "fold", "p")
                   .join(again.select("loan_id", "again"), "loan_id", "full")
                   .select(F.lit(r["kind"]).alias("kind"), "fold", "loan_id", (F.abs(F.col("p") - F.col("again")) < 1e-12).alias("same")))
    rows = reduce(DataFrame.unionByName, out)
    return finalize(rows.groupBy("kind", "fold", "loan_id").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.coalesce(F.col("same"), F.lit(False)).cast("int")).alias("same")))


@query
def random_search(spark, sf):
    """20 sampled trials of the mappable boosting parameters, each over all folds."""
    from .tune import random_search_cv
    folded, numeric, cats = _mllib_frame(spark, sf)
    return finalize(random_search_cv(folded, "loan_id", numeric, cats, "isDefault", "fold", 20, SEED))


# ---------------------------------------------------------------- streaming
@query
def stream_score(spark, sf):
    """The cleaned test table lands as files; a streaming query encodes and scores it."""
    from ..session import shared_path
    from ..streaming.score_stream import run_score_stream
    from .models import Dims, parity_params
    prep, _, fd = _encoded(spark, sf)
    src = shared_path(spark, "stream-src")
    prep.test.write.parquet(src)
    dims = Dims(feature_dim=fd.feature_dim, field_size=fd.field_size)
    sink = run_score_stream(spark, src, prep.test.schema, fd, "deepfm", parity_params("deepfm", dims), dims,
                            "loan_id")
    return finalize(spark.read.parquet(sink))


@query
def union_train(spark, sf):
    """Both aligned train tables stacked (bag union; the reference keeps this path commented
    out and trains on the internet table alone)."""
    bank, internet, _, _ = _aligned(spark, sf)
    return finalize(bank.unionByName(internet).select("loan_id", "slice", "total_loan", "isDefault"))
