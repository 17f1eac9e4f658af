"""Fold export: cleaned table → feature dictionary → encoded records → stratified folds →
Parquet partitioned by fold (each record once; splits are read with partition pruning)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.dictionary import FeatureDictionary, fit_feature_dictionary
from ..operators.encode import encode_xi_xv
from ..operators.split import stratified_kfold
from ..roles import Roles
from ..sources.records import sink_folds


@dataclass
class Exported:
    path: str
    fd: FeatureDictionary
    encoded: DataFrame


def encode_table(df: DataFrame, roles: Roles, seed: int, fd: FeatureDictionary | None = None):
    fd = fd or fit_feature_dictionary(df, roles)
    return encode_xi_xv(df, fd, roles.key, roles.target, seed), fd


def export_folds(df: DataFrame, roles: Roles, k: int, seed: int, path: str,
                 fd: FeatureDictionary | None = None) -> Exported:
    enc, fd = encode_table(df, roles, seed, fd)
    folds = stratified_kfold(enc, "label", roles.key, k, seed)
    sink_folds(folds, path)
    return Exported(path, fd, enc)
