"""Shared helpers for registered queries: fixture tables, output normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
SEED = 42
K = 3


def finalize(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Stable output types for comparisons: integers → bigint, floats → double rounded to
    ``digits`` places, timestamps → text."""
    cols = []
    for name, t in df.dtypes:
        c = F.col(f"`{name}`")
        if t in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        elif t in ("float", "double") or t.startswith("decimal"):
            c = F.round(c.cast("double"), digits)
        elif t.startswith("timestamp") or t == "date":
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)
