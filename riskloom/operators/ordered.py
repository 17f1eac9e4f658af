"""Distributed ordered passes: row numbers, running aggregates and fills in a global order.

Spark has no row order, and ``Window.orderBy`` without a partition (or partitioned only by
a binary label) sends every row to one task. Here the order is cut into *buckets* that are
monotone in the order (quantile splits of a numeric key, or the leading hex digits of an
md5 order key). Each pass is then:

1. a local window inside each (group, bucket) — many balanced tasks;
2. one summary row per (group, bucket) (count, sum, max, last non-null, ...);
3. a tiny window over those summaries in bucket order gives each bucket its carry;
4. the carry is joined back and combined with the local value (the session's own size check
   decides whether the summary is broadcast).

The bucketed input is staged as Parquet first: the window and the summary read that, so the
plan above an ordered pass runs once. The result depends only on the data, never on how it
is partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import MAX_BROADCAST_BYTES, materialize, sized_join

BUCKET = "_obucket"


@dataclass(frozen=True)
class Agg:
    """One running aggregate. kind: sum | max | min | count | last (last non-null seen)."""
    kind: str
    expr: Column


def hash_order_key(key: Column | str, seed: int | str) -> Column:
    """Seeded pseudo-random order key: md5 of ``key:seed`` (identical in DuckDB)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hex_bucket(hex_col: Column | str, digits: int = 3) -> Column:
    """Monotone bucket of an md5 hex string: its leading ``digits`` hex digits (16**digits)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


class Splits(list):
    """Split points of a key; ``prefix``: bytes that all values of a text key begin with."""
    prefix = 0


TEXT_BYTES = 6  # bytes of a text key, after the common prefix, that place it in a bucket


def common_prefix(df: DataFrame, col: str) -> int | None:
    """Bytes shared by the smallest and the largest value, and so by all of them; None without values."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return None
    a, b = low.encode(), high.encode()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _numeric_input(df: DataFrame, col: str, prefix: int = 0) -> Column:
    """The key as a number that never decreases along the key's order."""
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        head = F.substring(F.col(col).cast("binary"), prefix + 1, TEXT_BYTES)
        return F.conv(F.rpad(F.hex(head), 2 * TEXT_BYTES, "0"), 16, 10).cast("double")
    if dtype == "date":
        return F.unix_date(F.col(col)).cast("double")
    if dtype.startswith("timestamp"):
        # wall-clock microseconds: split points do not depend on the session time zone
        from ..functions.dates import epoch_micros
        return epoch_micros(col).cast("double")
    return F.col(col).cast("double")


def quantile_splits(df: DataFrame, col: str, n_buckets: int, relative_error: float | None = None) -> Splits:
    """Split points for ``n_buckets`` roughly even buckets of a numeric, temporal or text
    column: one approximate-quantile job; ``n_buckets`` numbers come back to the driver. The
    error follows the bucket count, so that many buckets stay distinct."""
    if n_buckets <= 1:
        return Splits([float("-inf"), float("inf")])
    tmp = "_oq_in"
    prefix = common_prefix(df, col) if dict(df.dtypes)[col] == "string" else 0
    if prefix is None:
        return Splits([float("-inf"), float("inf")])
    staged = df.select(_numeric_input(df, col, prefix).alias(tmp))
    qd = QuantileDiscretizer(numBuckets=n_buckets, inputCol=tmp, outputCol="_oq_b",
                             relativeError=relative_error or 1 / (4 * n_buckets), handleInvalid="keep")
    out = Splits(qd.fit(staged).getSplits())
    out.prefix = prefix
    return out


def with_bucket_splits(df: DataFrame, col: str, splits: list[float], out: str = BUCKET) -> DataFrame:
    """Bucket = index of the split interval holding ``col`` (monotone in ``col``; NaN goes to the last
    bucket, a null has none, which sorts first as it does)."""
    if len(splits) <= 2:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer
    tmp = "_oq_in"
    b = Bucketizer(splits=list(splits), inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, _numeric_input(df, col, getattr(splits, "prefix", 0))))
             .withColumn(out, F.col(out).cast("int")).drop(tmp))


def with_pair_bucket(df: DataFrame, major: str, minor: str, n_buckets: int, out: str = BUCKET) -> DataFrame:
    """Bucket column that is monotone in (``major``, ``minor``): the whole numbers of ``major``
    plus the place of ``minor`` in its range, so that many rows of one ``major`` are spread."""
    prefix = (common_prefix(df, minor) or 0) if dict(df.dtypes)[minor] == "string" else 0
    place = _numeric_input(df, minor, prefix)
    low, high = df.agg(F.min(place), F.max(place)).first()
    if low is None:
        return df.withColumn(out, F.lit(0))
    tmp = "_oq_pair"
    d = df.withColumn(tmp, F.col(major).cast("double") + (place - low) / F.lit(float(high - low) + 1.0))
    return with_quantile_bucket(d, tmp, n_buckets, out=out).drop(tmp)


def with_quantile_bucket(df: DataFrame, col: str, n_buckets: int,
                         relative_error: float | None = None, out: str = BUCKET) -> DataFrame:
    """Add a bucket column that is monotone in a numeric, timestamp or text ``col``.

    Any split points keep the order exact; quantiles keep buckets even. At most ``COARSE`` split
    points are found by the driver; more buckets than that, and text keys that crowd, are cut
    inside the coarse buckets, on the executors.
    """
    text = dict(df.dtypes)[col] == "string"
    coarse = n_buckets if relative_error else min(n_buckets, COARSE)
    d = with_bucket_splits(df, col, quantile_splits(df, col, coarse, relative_error), out)
    return _refine(d, col, n_buckets, out) if n_buckets > 1 and (text or coarse < n_buckets) else d


COARSE = 1024  # most split points that the driver finds
FAN = 64       # split points inside one crowded bucket, in one round
SLOTS = 256    # a bucket's number times this, plus the place among its parts
PLACE_BYTES = 6
SETTLED = 32   # rows of a bucket that is left as it is, whatever its share


def _prefix_length(low: Column, high: Column) -> Column:
    """Bytes that two texts begin with in common."""
    a, b = low.cast("binary"), high.cast("binary")
    n = F.least(F.octet_length(low), F.octet_length(high))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, 0) - 1, n))


def _text_place(text: Column, prefix: Column) -> Column:
    """The bytes after the prefix as a number below 2**51, exact in a double, in the texts' order: a
    text that ends there comes before one that goes on with zero bytes."""
    head = F.rpad(F.hex(F.substring(text.cast("binary"), prefix + 1, F.lit(PLACE_BYTES))), 2 * PLACE_BYTES, "0")
    return F.conv(head, 16, 10).cast("long") * 8 + F.least(F.octet_length(text) - prefix, F.lit(PLACE_BYTES + 1))


def _refine(d: DataFrame, col: str, n_buckets: int, out: str) -> DataFrame:
    """Cut every bucket of more than twice its share (and ``SETTLED`` rows) again, until none with
    different keys is left.

    The quantiles of a crowded bucket are aggregated by bucket, for a text key over the bytes after
    the bucket's own common prefix, and joined to the rows as a table. A heavy value is a part of its
    own, so the next round reads further into it. Every round takes at least the bytes of one place
    further, or cuts. The driver sees two numbers a round. NaN stays behind all other keys; a null is
    before them, as in an ascending sort: without a bucket, or in the first."""
    text = dict(d.dtypes)[col] == "string"
    value = F.col(col) if text else F.nanvl(_numeric_input(d, col), F.lit(None).cast("double"))
    rounds = 0
    while True:
        info = materialize(d.groupBy(F.col(out).alias("_ob")).agg(
            F.count(value).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")))
        share = (info.agg(F.sum("_n")).first()[0] or 0) / n_buckets
        large = info.where((F.col("_n") > max(2 * share + 1, SETTLED)) & (F.col("_low") != F.col("_high")))
        count = large.count()
        if not count:
            return _dense(d, out) if rounds else d
        rounds += 1
        # parts of about a share: every so manieth of the bucket's quantiles
        every = F.greatest(F.lit(1), F.floor(F.lit(FAN * share) / F.col("_n")).cast("int"))
        prefix = _prefix_length(F.col("_low"), F.col("_high")) if text else F.lit(0)
        large = materialize(large.select("_ob", prefix.alias("_op"), every.alias("_every")))
        place = _text_place(F.col(col), F.col("_op")) if text else value
        placed = (sized_join(d, large, d[out] == large["_ob"], "left", right_rows=count)
                  .withColumn("_place", F.when(F.col("_ob").isNotNull(), place)))
        cuts = materialize(placed.where("_ob is not null").groupBy(F.col("_ob").alias("_cb")).agg(
            F.percentile_approx("_place", [i / FAN for i in range(FAN)], 16 * FAN).alias("_q"), F.first("_every").alias("_e"))
            .select("_cb", F.expr("array_distinct(filter(_q, (q, i) -> i % _e = 0))").alias("_cuts")))
        part = F.expr("size(filter(_cuts, c -> c < _place)) + size(filter(_cuts, c -> c <= _place))")
        part = (F.when(F.col("_cuts").isNull() | F.col(col).isNull(), 0).when(F.col("_place").isNull(), SLOTS - 1)
                .otherwise(part))
        # staged: the next round's passes read this, not the joins of all rounds before
        d = materialize(sized_join(placed, cuts, placed["_ob"] == cuts["_cb"], "left", max_broadcast_bytes=MAX_BROADCAST_BYTES // FAN,
                        right_rows=count)
             .withColumn(out, F.col(out).cast("long") * SLOTS + part)
             .drop("_ob", "_op", "_every", "_place", "_cb", "_cuts"))
        if rounds % 5 == 0:
            d = _dense(d, out)  # before the numbers leave 64 bits


def _dense(d: DataFrame, out: str) -> DataFrame:
    """The same buckets numbered from 0 (a window over one row per bucket); none stays none."""
    numbers = materialize(d.where(F.col(out).isNotNull()).select(F.col(out).alias("_ob")).distinct()
                          .withColumn("_dense", F.row_number().over(Window.orderBy("_ob")) - 1))
    return sized_join(d, numbers, d[out] == numbers["_ob"], "left").withColumn(out, F.col("_dense")).drop("_ob", "_dense")


def _local(kind: str, expr: Column, frame) -> Column:
    if kind == "sum":
        return F.sum(expr).over(frame)
    if kind == "count":
        return F.count(expr).over(frame)
    if kind == "max":
        return F.max(expr).over(frame)
    if kind == "min":
        return F.min(expr).over(frame)
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(frame)
    raise ValueError(kind)


def _total(kind: str, expr: Column, order: list[Column], descending: bool) -> Column:
    if kind == "sum":
        return F.sum(expr)
    if kind == "count":
        return F.count(expr)
    if kind == "max":
        return F.max(expr)
    if kind == "min":
        return F.min(expr)
    if kind == "last":
        # the non-null value latest in scan order inside the bucket
        if len(order) == 1:
            # ordering masked to null where the value is null: min_by/max_by skip those rows,
            # and with fixed-width types the buffer hash-aggregates map-side (no sort)
            ordering = F.when(expr.isNotNull(), order[0])
            return F.min_by(expr, ordering) if descending else F.max_by(expr, ordering)
        tagged = F.when(expr.isNotNull(), F.struct(*order, expr.alias("_v")))
        return (F.min(tagged) if descending else F.max(tagged))["_v"]
    raise ValueError(kind)


def _carry(kind: str, col: Column, frame) -> Column:
    if kind in ("sum", "count"):
        return F.sum(col).over(frame)
    if kind == "max":
        return F.max(col).over(frame)
    if kind == "min":
        return F.min(col).over(frame)
    if kind == "last":
        return F.last(col, ignorenulls=True).over(frame)
    raise ValueError(kind)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    if kind == "last":
        return F.coalesce(local, carry)
    raise ValueError(kind)


def running(df: DataFrame, aggs: dict[str, Agg], order_cols: list[str], bucket: Column | str,
            partition_by: list[str] | tuple = (), inclusive: bool = True,
            descending: bool = False, stage: bool = True) -> DataFrame:
    """Add running aggregates over the global order ``order_cols`` (unique, ascending unless
    ``descending``) within each ``partition_by`` group.

    ``bucket`` must be non-decreasing in ``order_cols`` (descending: still computed on the
    ascending order; the scan runs from high to low buckets). ``inclusive`` includes the
    current row. ``stage=False``: ``df`` is already a staged table, cheap to read twice.
    """
    pby = list(partition_by)
    bcol = F.col(bucket) if isinstance(bucket, str) else bucket
    d = df.withColumn(BUCKET, bcol)
    if stage:
        d = materialize(d)
    keys = [*pby, BUCKET]
    order = [F.col(c) for c in order_cols]
    scan = [o.desc() for o in order] if descending else order
    frame = (Window.partitionBy(*keys).orderBy(*scan)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))

    local_cols = {f"_l_{n}": _local(a.kind, a.expr, frame) for n, a in aggs.items()}
    with_local = d.select("*", *[c.alias(n) for n, c in local_cols.items()])

    # Per-bucket totals with map-side partial aggregation: one more scan of the staged rows and
    # a bucket-sized shuffle; the window above keeps the only full-size exchange.
    totals = d.groupBy(*keys).agg(
        *[_total(a.kind, a.expr, order, descending).alias(f"_t_{n}") for n, a in aggs.items()])
    bscan = F.col(BUCKET).desc() if descending else F.col(BUCKET)
    bframe = (Window.partitionBy(*pby).orderBy(bscan)
              .rowsBetween(Window.unboundedPreceding, -1))
    carries = totals.select(
        *keys, *[_carry(a.kind, F.col(f"_t_{n}"), bframe).alias(f"_c_{n}")
                 for n, a in aggs.items()])
    joined = with_local.join(carries, keys, "left")
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(a.kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
          for n, a in aggs.items()])
    return out


def row_number(df: DataFrame, order_cols: list[str], bucket: Column | str,
               partition_by=(), out: str = "rn", **kw) -> DataFrame:
    """0-based position in the global order (within each partition_by group)."""
    res = running(df, {out: Agg("count", F.lit(1))}, order_cols, bucket, partition_by, **kw)
    return res.withColumn(out, (F.col(out) - 1).cast("long"))


def backfill(df: DataFrame, cols: list[str], order_cols: list[str], bucket: Column | str,
             partition_by=(), **kw) -> DataFrame:
    """Each null takes the next non-null value in the order (pandas ``bfill``); trailing
    nulls stay null."""
    aggs = {f"_bf_{c}": Agg("last", F.col(c)) for c in cols}
    res = running(df, aggs, order_cols, bucket, partition_by, descending=True, **kw)
    return res.select(*[F.col(f"_bf_{c}").alias(c) if c in cols else F.col(c)
                        for c in df.columns])
