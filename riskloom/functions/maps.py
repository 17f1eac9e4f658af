"""Literal dictionary maps and constant fills."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's literal code tables.
WORK_YEAR_MAP = {"10+ years": 10, "2 years": 2, "< 1 year": 0, "3 years": 3, "1 year": 1,
                 "5 years": 5, "4 years": 4, "6 years": 6, "8 years": 8, "7 years": 7,
                 "9 years": 9}
CLASS_MAP = {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4, "F": 5, "G": 6}
WORK_YEAR_TRAIN_FILL = "10+ years"
WORK_YEAR_TEST_FILL = "work_year"

# The fixture's class column holds order priorities (five levels).
PRIORITY_CLASS_MAP = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3,
                      "5-LOW": 4}


def map_literal(col: Column | str, mapping: dict) -> Column:
    """Look ``col`` up in a literal dict; unknown keys and nulls give null (never raise)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.try_element_at(m, c))


def fill_constant(col: Column | str, value) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(value))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """pandas has one missing value, Spark two: turn float NaN into null."""
    kinds = dict(df.dtypes)
    floats = [c for c, t in df.dtypes if t in ("double", "float") and (cols is None or c in cols)]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) for c in floats})
