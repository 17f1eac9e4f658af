"""A sample of registered queries against their DuckDB oracle at sf0.001 (the full set runs
with ``python tests/oracle_compare.py``)."""
import re

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

from paths import SF_SMALL

SAMPLE = ["app_fixture", "freq_dictionary", "backfill_global", "backfill_by_key", "prepare_train",
          "stratified_kfold", "auc_exact", "auc_thresholded", "early_stop_epoch", "feature_dictionary",
          "encode_xi_xv", "fm_second_order", "score_deepfm", "sample_trials", "oof_assemble",
          "export_folds", "scan_fold", "stream_score", "auc_with_missing_scores", "scale_with_nan",
          "backfill_with_nan", "renumber_text_keys", "categorical_codes", "gradient_step_deepfm",
          "mmoe_head_metrics", "cv_summary", "gradient_step_sparse", "score_fm_only", "score_deep_only"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["ok"], r["note"]


def test_every_query_has_oracle_or_is_iterative():
    own = {n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n)}  # not the corpus operators
    no_sql = own - set(E.oracle_sql())
    assert no_sql <= {"train_deepfm", "train_afm", "train_mmoe", "cv_by_model", "train_gbt_cv",
                      "train_fm", "train_mlp", "random_search", "network_search"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and set(df.columns) == {"fold", "isDefault", "n", "mean_scaled_loan"}


INVARIANT = ["backfill_global", "backfill_by_key", "stratified_kfold", "undersample_balance",
             "auc_exact", "early_stop_epoch", "feature_dictionary", "renumber_rows",
             "freq_dictionary", "distinct_first_seen", "encode_xi_xv", "score_deepfm",
             "oof_assemble", "sample_trials", "batch_rows"]


@pytest.mark.parametrize("name", INVARIANT)
def test_same_result_for_any_bucketing(spark, name):
    """Changing the shuffle partition count changes every bucket count and partitioning;
    the answer must not move."""
    from collections import Counter
    from oracle_compare import rows_of
    fn = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for parts in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = fn(spark, SF_SMALL)
            out.append(Counter(rows_of(df.columns, [tuple(r) for r in df.collect()])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]
