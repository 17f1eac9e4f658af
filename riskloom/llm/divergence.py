"""Source divergence audit: how differently the sources of a language use its frequent terms.

Texts are tokenised as bytes: one ``bytes.translate`` lowers A-Z and blanks every separator, one
``bytes.split`` gives the terms (runs of letters and of bytes beyond ASCII), one ``Counter`` per
document gives counts and, by its keys, document frequencies. Long texts are split piece by piece
at separators. A task adds its documents up per (lang, source) and hands on sparse
(lang, source, term, count, documents) rows, which Spark sums; nothing is held per group.

A language keeps the terms of at least ``least`` of its documents. A group's estimate of a term is
p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)): terms that a group lacks all share one p, so sums
over all kept terms need only the rows of terms that occur. Two reports:

- ``pair``: the sum of |p - q| over all kept terms for every two sources of a language. Terms are
  dealt into buckets and sources into tiles; a task holds one bucket's terms of two tiles as a
  matrix, and terms absent from both sources are added as one product.
- ``term``: the kept terms that a group uses most beyond the language's own p, down to rank 50.

Defined results: null text, lang and source are ''; repeated rows and rows with a null id count
each; a group without terms takes part with N = 0; a language without kept terms has V = 0 and
pairs of value 0; ties go to the smaller item (UTF-8); an empty table gives no rows; other columns
are ignored. All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import sized_join
from ..session import ship_package
from .common import staged

LEAST, TOP = 30, 50
ONE = 1_000_000_000
PIECE = 1 << 20  # bytes of a text that are split at a time
HELD = 200_000  # (group, term) counts that a task holds
TILE = 256  # sources whose terms a task compares with as many others
TERMS = 256  # kept terms of a bucket

# upper-case letters to lower case; ASCII bytes that are no letters to blanks; the rest stays
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Terms of one text and how often each occurs."""
    data = text.translate(TABLE)
    if len(data) <= PIECE:
        return Counter(data.split())
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def entries(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents that hold the term. The empty term
    (no text has it) names every group and counts its documents."""
    ship_package(docs.sparkSession)

    def run(batches):
        count: dict = defaultdict(Counter)
        files: dict = defaultdict(Counter)
        held = 0

        def settle():
            rows = [(*g, t, n, files[g][t]) for g, c in count.items() for t, n in c.items()]
            lang, source, term, n, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(source), pa.array([t.decode() for t in term]), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                names=["lang", "source", "term", "n", "d"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = term_counts(texts[i].as_py())
                found[b""] = 1
                mine = count[group]
                held -= len(mine)
                mine.update(found)
                files[group].update(found.keys())
                held += len(mine)
                if held > HELD:
                    yield settle()
                    count.clear()
                    files.clear()
                    held = 0
        if held:
            yield settle()

    found = docs.mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p; ``terms`` above 0. By decimals: a billion times a count may pass a long."""
    d = "decimal(38,0)"
    up = F.lit(ONE).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return (F.call_function("div", up.cast(d), (total + 5 * terms).cast(d)) + 1).cast("bigint")


def kept_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, n): the terms of at least ``least`` of a language's documents."""
    whole = rows.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return whole.where(F.col("d") >= least).drop("d")


def _distances(tiles: DataFrame) -> DataFrame:
    """(lang, a, b, s, m) from (lang, ta, tb, bucket, source, term, p, zero, side): s sums
    |p_a - p_b| over the bucket's terms that some source of the two tiles has, m counts them. Rows
    without a term name the tiles' sources."""
    def run(key, table):
        sources = table.column("source").combine_chunks().dictionary_encode()
        names, place = np.unique(np.array(sources.dictionary.to_pylist(), object), return_inverse=True)
        at = place[sources.indices.to_numpy()]
        terms = table.column("term").combine_chunks().dictionary_encode()
        line = terms.indices.fill_null(-1).to_numpy()
        has = line >= 0
        base, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        base[at], side[at] = table.column("zero").to_numpy(), table.column("side").to_numpy()
        grid = np.broadcast_to(base[:, None], (len(names), len(terms.dictionary))).copy()
        grid[at[has], line[has]] = table.column("p").to_numpy()[has]
        order = np.arange(len(names)) if key[1].as_py() == key[2].as_py() else side
        a, b, s = [], [], []
        for i in range(len(names)):
            j = np.flatnonzero(order > order[i])
            a.append(np.full(len(j), i))
            b.append(j)
            s.append(np.abs(grid[j] - grid[i]).sum(axis=1))
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(names[a], pa.string()),
                         "b": pa.array(names[b], pa.string()), "s": pa.array(s, pa.int64()),
                         "m": pa.array(np.full(len(a), grid.shape[1]), pa.int64())})

    return tiles.groupBy("lang", "ta", "tb", "bucket").applyInArrow(run, "lang string, a string, b string, s bigint, m bigint")


def pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language. ``scored``: lang, source, term, p of
    the kept terms that occur; ``groups``: lang, source, zero (p of a term the group lacks), v,
    tile, tiles, buckets."""
    own = groups.select("lang", "source", "zero", "tile", "tiles", "buckets")
    named = sized_join(scored.select("lang", "source", "term", "p"), own, ["lang", "source"], "inner").withColumn(
        "bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    # a group takes part in every bucket of its language's terms, with or without terms in it
    bare = own.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumns(
        {"term": F.lit(None).cast("string"), "p": F.col("zero")})
    dealt = named.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "bucket",
                         "source", "term", "p", "zero", F.col("tile").alias("side"))
    sums = _distances(dealt).groupBy("lang", "a", "b").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    mine = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
    theirs = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    full = sized_join(sized_join(sums, mine, ["lang", "a"], "inner"), theirs, ["lang", "b"], "inner")
    return full.select("lang", "a", "b", (F.col("s") + (F.col("v") - F.col("m")) * F.abs(F.col("za") - F.col("zb"))).alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of both reports."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    docs = df.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))
    rows = staged(entries(docs), "divergence-entries")
    kept = staged(kept_terms(rows, least), "divergence-kept")
    known = rows.join(kept.select("lang", "term", F.col("n").alias("whole")), ["lang", "term"])
    known = staged(known.select("lang", "source", "term", "n", "whole"), "divergence-known")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (rows.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
              .na.fill(0, ["v", "lang_n", "total"]))
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0))
    by_lang = Window.partitionBy("lang")  # a row per source
    groups = groups.withColumns({"zero": zero.cast("bigint"), "tiles": F.ceil(F.count(F.lit(1)).over(by_lang) / TILE).cast("int"),
                                 "buckets": F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")})
    groups = staged(groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "divergence-groups")

    scored = sized_join(known, groups.select("lang", "source", "total", "v", "lang_n"), ["lang", "source"], "inner")
    scored = staged(scored.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                                  share(F.col("whole"), F.col("lang_n"), F.col("v")).alias("q")), "divergence-scored")

    met = pairs(scored, groups)
    both = met.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        met.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    above = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # the limit reaches below the shuffle: a task hands on at most ``top`` rows of a group
    first = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return ranked.select(*columns).unionByName(first.select(*columns))


def digest(df: DataFrame) -> DataFrame:
    return audit(df)
