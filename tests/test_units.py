"""Hand-made unit tables: one quirk each."""
import datetime as dt
import math
import warnings

import pytest
from pyspark.sql import functions as F

from riskloom.functions.dates import date_features
from riskloom.operators import dictionary as D
from riskloom.operators import metrics as M
from riskloom.operators.scale import scale_min_std
from riskloom.operators.split import undersample_balance
from riskloom.plans.prepare import backfill_all
from riskloom.plans.tune import gbt_params
from riskloom.roles import Roles


def test_freq_dictionary_ties_first_seen(spark):
    df = spark.createDataFrame(list(enumerate("zbabzc")), "k long, v string")
    d = {r["value"]: r["code"] for r in D.freq_dictionary(df, "v", "k", n_buckets=3).collect()}
    assert d == {"z": 0, "b": 1, "a": 2, "c": 3}


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_backfill_holes(spark, buckets):
    df = spark.createDataFrame(list(enumerate([None, 3, None, None, 9, None])), "k long, v long")
    got = [r["v"] for r in backfill_all(df, "k", n_buckets=buckets).orderBy("k").collect()]
    assert got == [3, 3, 9, 9, 9, None]


def test_day_difference_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2007, 5, 31, 23), ), (dt.datetime(2007, 6, 1, 23), )],
                               "issue_date timestamp_ntz")
    got = [r["issue_date_diff"] for r in date_features(df).collect()]
    assert got == [-1, 0]


def test_scale_spread_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "k long, a double, b double")
    rows = scale_min_std(df, ["a", "b"]).orderBy("k").collect()
    assert [round(r["a"], 6) for r in rows] == [0.0, 0.801784, 2.405351]
    assert all(r["b"] is None for r in rows)


def test_exact_auc_with_tie(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, y int")
    assert M.auc_exact(df, "p", "y").first()["auc"] == pytest.approx(0.75)


def _history(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "run long, ep long, v double")


def test_plateau_stops_at_16(spark):
    h = _history(spark, [1.0] + [0.5] * 15)
    r = M.early_stop_epoch(h, "run", "ep", "v").collect()
    assert [x["stop_t"] for x in r] == [16]


def test_plateau_tie_does_not_stop(spark):
    h = _history(spark, [1.0] + [0.5] * 7 + [1.0] + [0.5] * 7)
    assert M.early_stop_epoch(h, "run", "ep", "v").count() == 0


def test_short_history_never_stops(spark):
    h = _history(spark, [15 - i for i in range(15)])
    assert M.early_stop_epoch(h, "run", "ep", "v").count() == 0


def test_balance_raises_when_majority_smaller(spark):
    df = spark.createDataFrame([(i, 1 if i < 5 else 0) for i in range(8)], "k long, y int")
    with pytest.raises(ValueError):
        undersample_balance(df, "y", "k", 42)


def test_balance_equal_classes(spark):
    df = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(400)], "k long, y int")
    counts = {r["y"]: r["count"] for r in undersample_balance(df, "y", "k", 42).groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 100


def test_category_codes_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    got = {r["v"]: r["code"] for r in D.category_codes(df, "v").collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_unknown_role_name_warns():
    r = Roles(numeric=("a",), ignore=("knowing_outstanding_loan",))
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        missing = r.validate(["a", "known_outstanding_loan"])
    assert missing == ["knowing_outstanding_loan"] and w


def test_role_precedence_ignore_first():
    r = Roles(numeric=("f1", "x"), ignore=("f1",))
    assert r.kind("f1") == "ignore" and r.kind("x") == "numeric" and r.kind("y") == "categorical"


def test_unsupported_boosting_parameter():
    with pytest.raises(ValueError):
        gbt_params({"num_leaves": 31})
    assert gbt_params({"n_estimators": 10, "feature_fraction": 0.5}) == {
        "maxIter": 10, "featureSubsetStrategy": "0.5"}


def test_wrong_record_width_fails(spark):
    from riskloom.operators.encode import check_width
    df = spark.createDataFrame([([1, 2], [1.0, 2.0])], "xi array<int>, xv array<float>")
    with pytest.raises(Exception):
        check_width(df, 3).collect()
    assert check_width(df, 2).count() == 1


def test_drift_report_and_alignment(spark):
    from riskloom.operators.align import align_common_columns
    bank = spark.createDataFrame([(1, 2.0, "x", 1)], "loan_id long, a double, bank_only string, isDefault int")
    net = spark.createDataFrame([(2, 3.0, 0, 5)], "loan_id long, a double, is_default int, net_only long")
    test = spark.createDataFrame([(3, 4.0)], "loan_id long, a double")
    b, n, t, rep = align_common_columns(bank, net, test)
    assert b.columns == n.columns == ["loan_id", "a", "isDefault"]
    assert t.columns == ["loan_id", "a"]
    assert rep.left_only == ("bank_only",) and rep.right_only == ("net_only",) and rep.common_count == 3
