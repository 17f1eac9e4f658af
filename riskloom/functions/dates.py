"""Date parsing and date-derived features (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the day the reference counts issue dates from.
BASE_DATE = "2007-06-01"


def parse_date(col: Column | str, fmt: str | None = None, strict: bool = True) -> Column:
    """Text → timestamp without time zone (wall-clock, like pandas ``to_datetime``), so the
    result does not depend on the session time zone. ``strict`` raises on bad text (as
    pandas does); otherwise bad text becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        return F.to_timestamp_ntz(c) if fmt is None else F.to_timestamp_ntz(c, F.lit(fmt))
    parsed = F.try_to_timestamp(c) if fmt is None else F.try_to_timestamp(c, F.lit(fmt))
    return F.when(parsed.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(
        F.to_timestamp_ntz(c) if fmt is None else F.to_timestamp_ntz(c, F.lit(fmt)))


def epoch_micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp (zone-free)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def days_since(col: Column | str, base: str = BASE_DATE) -> Column:
    """Whole days from ``base`` (midnight) to ``col``, floored: 23:00 the day before → -1."""
    c = F.col(col) if isinstance(col, str) else col
    return F.datediff(F.to_date(c), F.to_date(F.lit(base)))


def date_features(df: DataFrame, col: str = "issue_date", base: str = BASE_DATE,
                  drop: bool = True) -> DataFrame:
    """Append ``<col>_y``, ``<col>_m``, ``<col>_diff`` and (by default) drop ``col``."""
    ts = parse_date(col) if dict(df.dtypes)[col] == "string" else F.col(col)
    out = df.withColumns({
        f"{col}_y": F.year(ts),
        f"{col}_m": F.month(ts),
        f"{col}_diff": days_since(ts, base),
    })
    return out.drop(col) if drop else out
