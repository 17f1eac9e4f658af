"""Column statistics and the (x - min) / std_pop scaler."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maps import nan_to_null


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (column, min, std_pop, non_null): one aggregate pass, nulls skipped."""
    df = nan_to_null(df, cols)
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"),
                 F.stddev_pop(c).cast("double").alias(f"{c}__std"),
                 F.count(c).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__min`, `{c}__std`, `{c}__n`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, min, std_pop, non_null)")


@dataclass(frozen=True)
class MinStdScaler:
    """Fitted scaler: per column (min, population std). Holds 2 numbers per column."""
    stats: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_columns(nan_to_null(df, list(self.stats)), list(self.stats), lambda c, s: _scaled(c, *s), self.stats)


def _scaled(c: Column, lo, sd) -> Column:
    if lo is None or sd is None or sd == 0:
        # constant or empty column: pandas gives NaN, we give null
        return F.lit(None).cast("double")
    return (c.cast("double") - F.lit(lo)) / F.lit(sd)


def fit_min_std(df: DataFrame, cols: list[str]) -> MinStdScaler:
    """One aggregate job; 2 numbers per column come back to the driver."""
    if not cols:
        return MinStdScaler({})
    df = nan_to_null(df, cols)
    row = df.agg(*[x for c in cols for x in (F.min(c).cast("double").alias(f"{c}__min"),
                                             F.stddev_pop(c).alias(f"{c}__std"))]).first()
    return MinStdScaler({c: (row[f"{c}__min"], row[f"{c}__std"]) for c in cols})


def scale_min_std(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale ``cols`` by statistics fitted on ``fit_on`` (default: ``df`` itself)."""
    return fit_min_std(fit_on if fit_on is not None else df, cols).transform(df)


def apply_columns(df: DataFrame, cols: list[str], fn: Callable[[Column, object], Column],
                  stats: dict | None = None) -> DataFrame:
    """Apply one column function to many columns in a single projection."""
    stats = stats or {}
    return df.withColumns({c: fn(F.col(c), stats.get(c)) for c in cols})
