"""Schema algebra: align differently shaped tables, project, filter by label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DriftReport:
    """Column counts and per-side leftovers of an alignment (driver-side schema facts)."""
    left_count: int
    right_count: int
    common_count: int
    left_only: tuple[str, ...]
    right_only: tuple[str, ...]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns present in both, in the left table's order."""
    rc = set(right.columns)
    return [c for c in left.columns if c in rc]


def drift_report(left: DataFrame, right: DataFrame) -> DriftReport:
    common = common_columns(left, right)
    return DriftReport(len(left.columns), len(right.columns), len(common),
                       tuple(c for c in left.columns if c not in common),
                       tuple(c for c in right.columns if c not in common))


def align_common_columns(bank: DataFrame, internet: DataFrame, test: DataFrame | None = None,
                         target: str = "isDefault", renames: dict | None = None):
    """Rename the label to its canonical name, keep the common columns (bank order) in the
    two train tables and the same columns minus the label in the test table.

    Returns ``(bank, internet, test, report)``; ``test`` is None if not given.
    """
    renames = {"is_default": target} if renames is None else renames
    internet = internet.withColumnsRenamed({k: v for k, v in renames.items() if k in internet.columns})
    bank = bank.withColumnsRenamed({k: v for k, v in renames.items() if k in bank.columns})
    common = common_columns(bank, internet)
    report = drift_report(bank, internet)
    out_test = None
    if test is not None:
        out_test = project_unlabelled(test, common, target)
    return bank.select(*common), internet.select(*common), out_test, report


def project_unlabelled(df: DataFrame, columns: list[str], target: str = "isDefault") -> DataFrame:
    """All given columns except the label (by name, not by position)."""
    return df.select(*[c for c in columns if c != target])


def filter_label(df: DataFrame, target: str, value: int) -> DataFrame:
    return df.where(F.col(target) == value)
