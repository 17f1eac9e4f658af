"""Cleaning plan: align → date features → dictionaries → literal maps → back-fill → scale →
balance, and the fold export built on it.

Fitted state (two frequency dictionaries, the scaler statistics, the feature dictionary) is
small and explicit; row data stays distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import BASE_DATE, date_features
from ..functions.maps import (CLASS_MAP, WORK_YEAR_MAP, WORK_YEAR_TEST_FILL,
                              WORK_YEAR_TRAIN_FILL, fill_constant, map_literal, nan_to_null)
from ..operators import ordered
from ..operators.align import DriftReport, align_common_columns
from ..operators.dictionary import apply_dictionary, freq_dictionaries
from ..operators.joins import materialize
from ..operators.scale import MinStdScaler, fit_min_std
from ..operators.split import undersample_balance
from ..roles import Roles
from ..session import default_buckets


@dataclass
class CleanSpec:
    """Column names and literal tables of one cleaning run (defaults: the reference's)."""
    date_col: str = "issue_date"
    base_date: str = BASE_DATE
    work_year_col: str = "work_year"
    work_year_map: dict = field(default_factory=lambda: dict(WORK_YEAR_MAP))
    train_fill: str = WORK_YEAR_TRAIN_FILL
    test_fill: str = WORK_YEAR_TEST_FILL
    class_col: str = "class"
    class_map: dict = field(default_factory=lambda: dict(CLASS_MAP))
    freq_cols: tuple[str, ...] = ("employer_type", "industry")
    renames: dict = field(default_factory=lambda: {"is_default": "isDefault"})


@dataclass
class Prepared:
    balanced: DataFrame
    raw: DataFrame          # back-filled, not scaled
    scaled: DataFrame       # back-filled and scaled
    test: DataFrame         # encoded and back-filled, not scaled
    dictionaries: dict
    scaler: MinStdScaler
    report: DriftReport


def encode_categories(df: DataFrame, spec: CleanSpec, dictionaries: dict, fill: str,
                      dict_rows: dict | None = None) -> DataFrame:
    """Date features, constant fill + literal maps, and frequency codes for one table."""
    out = date_features(df, spec.date_col, spec.base_date)
    out = out.withColumns({
        spec.work_year_col: map_literal(fill_constant(spec.work_year_col, fill), spec.work_year_map),
        spec.class_col: map_literal(spec.class_col, spec.class_map),
    })
    for c in spec.freq_cols:
        out = apply_dictionary(out, c, dictionaries[c], dict_rows=(dict_rows or {}).get(c))
    return out


def backfill_all(df: DataFrame, key: str, n_buckets: int | None = None,
                 partition_by=(), splits: list[float] | None = None) -> DataFrame:
    """pandas ``fillna(method='bfill')`` over every column in key order. ``splits`` (key
    bucket boundaries) may be shared between tables cut from the same key space."""
    cols = [c for c in df.columns if c != key and c not in partition_by]
    df = nan_to_null(df, cols)
    if splits is None:
        splits = ordered.quantile_splits(df.select(key), key, n_buckets or default_buckets(df.sparkSession))
    b = ordered.with_bucket_splits(df, key, splits)
    return ordered.backfill(b, cols, [key], ordered.BUCKET, partition_by=partition_by).drop(ordered.BUCKET)


def prepare(bank: DataFrame, internet: DataFrame, test: DataFrame, roles: Roles, seed: int,
            spec: CleanSpec | None = None, n_buckets: int | None = None,
            balance: bool = True) -> Prepared:
    spec = spec or CleanSpec()
    key, target = roles.key, roles.target
    bank, internet, test = (nan_to_null(t) for t in (bank, internet, test))
    bank_a, internet_a, test_a, report = align_common_columns(
        bank, internet, test, target=target, renames=spec.renames)
    # a misspelt role name would turn a column into a categorical feature: warn here
    made = ["issue_date_y", "issue_date_m", "issue_date_diff"]
    roles.validate([*internet_a.columns, *made])

    # dictionaries are fitted on the bank table, applied to all three (unseen → null)
    dicts, sizes = freq_dictionaries(bank_a, list(spec.freq_cols), key, n_buckets, with_sizes=True)
    train = encode_categories(internet_a, spec, dicts, spec.train_fill, sizes)
    test_c = encode_categories(test_a, spec, dicts, spec.test_fill, sizes)
    # one set of key buckets for both back-fills, from a narrow scan of the two key columns
    splits = ordered.quantile_splits(internet_a.select(key).unionByName(test_a.select(key)), key,
                                     n_buckets or default_buckets(bank.sparkSession))
    test_f = backfill_all(test_c, key, splits=splits)

    raw = materialize(backfill_all(train, key, splits=splits))
    # scaling covers every listed numeric column, ignored ones included (f1, title)
    numeric = [c for c in raw.columns if c in roles.numeric]
    scaler = fit_min_std(raw, numeric)
    scaled = scaler.transform(raw)
    balanced = undersample_balance(scaled, target, key, seed) if balance else None
    return Prepared(balanced, raw, scaled, test_f, dicts, scaler, report)


def app_spec() -> CleanSpec:
    """Spec for the loan-shaped fixture (its class column holds order priorities)."""
    from ..functions.maps import PRIORITY_CLASS_MAP
    return CleanSpec(class_col="class_raw", class_map=dict(PRIORITY_CLASS_MAP))
