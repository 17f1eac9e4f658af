"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the sorted array of the k smallest distinct shingle hashes (64 bits, read as signed
numbers). Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles. All of it is built-in column expressions.

A shingle is five words in a row; a text of one to four words is one shingle; a text without
words has the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import quantile_splits, with_bucket_splits
from .common import SPACE, shuffle_partitions

K = 256
WORDS = 5
MOST_BUCKETS = 50_000
BLANKS = " \t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    """Hash of every word of the text, in order."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(trimmed, SPACE), lambda w: F.xxhash64(w)))


def shingle_hashes(hashes: Column, words: int = WORDS) -> Column:
    """Hash of every shingle (not yet distinct). ``hashes`` should be a column, not an
    expression: it is read once per word of a shingle."""
    short = F.filter(F.array(F.xxhash64(hashes)), lambda _: F.size(hashes) > 0)
    full = F.transform(F.sequence(F.lit(0), F.size(hashes) - words),
                       lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]))
    return F.when(F.size(hashes) >= words, full).otherwise(short)


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of shingle hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches cover."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that lies in both. Two
    empty sketches are alike (1.0)."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) over the k-th hash's share of the range."""
    share = (F.element_at(sketch, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b also has."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def sketch_of_group(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """Merge the sketches of each group. Hashes are pre-aggregated (distinct) before they are
    numbered, and a salt spreads the hashes of a hot group over many tasks first."""
    salt = "_salt"
    flat = df.select(*keys, F.explode(sketch).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    first = Window.partitionBy(*keys, salt).orderBy("_h")
    last = Window.partitionBy(*keys).orderBy("_h")
    flat = (flat.withColumn(salt, F.pmod(F.col("_h"), F.lit(64)))
            .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
            .withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k))
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def printed(sketch: Column) -> Column:
    """The sketch's hashes as big-endian bytes in base64, on one line."""
    data = F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def edited(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) of the text replaced by as many first code points of the next."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def bucket_splits(df: DataFrame, order: str, rows_per_bucket: int = 1000) -> list[float]:
    """Approximate quantiles of ``order``: at most MOST_BUCKETS numbers come to the driver, whatever
    the input (beyond that the buckets grow)."""
    known = df.select(order).where(F.col(order).isNotNull())
    buckets = max(1, min(MOST_BUCKETS, known.count() // rows_per_bucket))
    return quantile_splits(known, order, buckets, relative_error=1 / (4 * buckets))


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; the estimated number of
    distinct shingles, and the estimated share of them that the edited and the next text keep.

    The order of ids is cut into buckets. Texts are shuffled once, by bucket; inside a bucket the
    next row is a window's lead. A bucket's last row takes the first row of the next bucket that
    has rows, from a table of bucket heads (one row each).

    Defined results: null text is the empty text; rows without an id have no next text (their tail
    is cut off, and ``near_next`` compares with the empty text); rows with equal ids follow each
    other in text order; other columns are ignored; an empty table gives no rows.
    """
    docs = df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cut = with_bucket_splits(docs, "_id", bucket_splits(docs, "_id"), "_bucket")
    # rows without an id: spread by their text, each a row of its own
    cut = cut.withColumn("_bucket", F.when(F.col("_id").isNull(), -1 - F.pmod(F.xxhash64("_text"), F.lit(1 << 20)))
                         .otherwise(F.col("_bucket")).cast("int"))

    hashed = (cut.repartition(shuffle_partitions(df.sparkSession), "_bucket")
              .withColumn("_h", word_hashes(F.col("_text"))))
    own = hashed.select("_id", "_text", "_bucket", bottom(shingle_hashes(F.col("_h")), k).alias("_fp"))
    order = Window.partitionBy("_bucket").orderBy("_id", "_text")
    ahead = own.select("*", F.lead("_text").over(order).alias("_next"), F.lead("_fp").over(order).alias("_next_fp"))

    # heads: the smallest (id, text) of each bucket, found on ids first so that few texts move
    firsts = cut.where(F.col("_id").isNotNull()).groupBy("_bucket").agg(F.min("_id").alias("_id"))
    # one row per bucket, of which there are at most MOST_BUCKETS
    heads = (docs.join(F.broadcast(firsts), "_id").groupBy("_bucket").agg(F.min("_text").alias("_edge")))
    # which bucket follows which: bucket numbers alone are ordered, and the texts joined to them
    ring = Window.orderBy("_bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select(F.col("_bucket").alias("_before"),
                            F.coalesce(F.lead("_bucket").over(ring), F.first("_bucket").over(whole)).alias("_bucket"))
    edges = heads.join(follows, "_bucket").select(F.col("_before").alias("_bucket"), "_edge")
    edges = edges.withColumn("_h", word_hashes(F.col("_edge")))
    edges = edges.select("_bucket", "_edge", bottom(shingle_hashes(F.col("_h")), k).alias("_edge_fp"))

    empty = F.array().cast("array<bigint>")
    last = F.col("_next").isNull()
    full = ahead.join(edges, "_bucket", "left").select(
        "_id", "_text", "_fp",
        F.when(F.col("_id").isNull(), F.lit("")).when(last, F.coalesce(F.col("_edge"), F.lit(""))).otherwise(F.col("_next")).alias("_next"),
        F.when(F.col("_id").isNull(), empty).when(last, F.coalesce(F.col("_edge_fp"), empty)).otherwise(F.col("_next_fp")).alias("_next_fp"))
    full = full.withColumn("_edited", edited(F.col("_text"), F.col("_next")))
    full = full.withColumn("_h", word_hashes(F.col("_edited")))
    full = full.select("_id", F.length("_text").cast("long").alias("n_chars"),
                       F.sha2("_edited", 256).alias("edited_sha256"), "_fp", "_next_fp",
                       bottom(shingle_hashes(F.col("_h")), k).alias("_efp"))
    return full.select(F.col("_id").alias(doc_id), "n_chars", "edited_sha256",
                       printed(F.col("_fp")).alias("fingerprint"), printed(F.col("_efp")).alias("edited_fingerprint"),
                       resemblance(F.col("_fp"), F.col("_efp"), k).alias("near_edited"),
                       resemblance(F.col("_fp"), F.col("_next_fp"), k).alias("near_next"),
                       distinct_shingles(F.col("_fp"), k).alias("n_shingles"),
                       containment(F.col("_fp"), F.col("_efp"), k).alias("kept_edited"),
                       containment(F.col("_fp"), F.col("_next_fp"), k).alias("kept_next"))
