"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected number of copies is target / source
size. Its whole part is always taken. The fractional parts are rounded dependently: two
documents at a time, mass moves at random from one to the other until one of them is whole. The
work is a reduction tree: documents of a source are grouped by size class and hash into blocks
of a few dozen; each block settles all of its documents but one, and the residuals of up to 32
blocks meet in the next level, until a source is left with one residual, which is rounded by
itself. So a source's total moves by less than a document or so from its target, and a source
that holds a third of all rows is as many blocks as it needs.

Defined results: null text has size 0 and is never taken; a null source is a source of its own,
last in order; rows with equal id, source and size share their copies as evenly as possible;
null ids are ordinary ids; an empty table gives no rows; other columns are ignored. Draws are
hashes of ids, so reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, uniform

CAP = 3
WEIGHTS = (1, 2, 3)
FAN_IN = 32
SEED = "mix-1"


def sized(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Words per document (null text: 0)."""
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                     F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. Shares follow the weights; a target stops at ``cap`` times its
    source's size, and the excess is shared again by weight until none is above: sources are
    capped in the order of cap * size / weight, up to the first whose share of what is left stays
    below its cap. One row per source: the windows see sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_no", F.row_number().over(by_name))
    per = per.withColumn("_w", F.get(wheel, F.pmod(F.col("_no") - 1, F.lit(len(weights)))))
    per = per.withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_r", "_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "source_size", "_w", "_cap", "_r", "_no",
                     F.row_number().over(fill).alias("_k"),
                     F.sum("source_size").over(everything).cast("double").alias("_all"),
                     F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_full"),
                     (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_left"))
    per = per.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_left"))
    first = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_k", "_level"))).over(everything)
    per = per.withColumn("_first", first)
    share = F.col("_first")["_level"] * F.col("_w")
    return per.select("source", "source_size",
                      F.when(F.col("_k") < F.col("_first")["_k"], F.col("_cap"))
                      .otherwise(F.least(share, F.col("_cap"))).alias("target"))


def _draw(a: Column, b: Column, level: int) -> Column:
    return uniform(F.lit(SEED), F.lit(level), a["doc_id"], a["hash"], b["doc_id"], b["hash"])


def settle(block: Column, level: int, id_type: str) -> Column:
    """struct(pend, done) of a block: every unit but one gets add = 0 or 1."""
    unit = f"struct<size:bigint,hash:bigint,doc_id:{id_type},p:double>"
    zero = F.struct(F.lit(None).cast(unit).alias("pend"),
                    F.array().cast(f"array<struct<hash:bigint,doc_id:{id_type},size:bigint,add:int>>").alias("done"))

    def moved(u, p):
        return F.struct(u["size"].alias("size"), u["hash"].alias("hash"), u["doc_id"].alias("doc_id"), p.alias("p"))

    def whole(u, add):
        return F.array(F.struct(u["hash"].alias("hash"), u["doc_id"].alias("doc_id"), u["size"].alias("size"),
                                F.lit(add).alias("add")))

    def step(acc, b):
        a = acc["pend"]
        total = a["p"] + b["p"]
        u = _draw(a, b, level)
        low = total < 1
        # below one: one of them takes all the mass; else: one of them becomes a copy
        a_keeps = F.when(low, u * total < a["p"]).otherwise(u * (2 - total) < 1 - a["p"])
        left = F.when(low, total).otherwise(total - 1)
        loser = F.when(low, F.when(a_keeps, whole(b, 0)).otherwise(whole(a, 0))).otherwise(
            F.when(a_keeps, whole(b, 1)).otherwise(whole(a, 1)))
        met = F.struct(F.when(a_keeps, moved(a, left)).otherwise(moved(b, left)).alias("pend"),
                       F.concat(acc["done"], loser).alias("done"))
        return F.when(a.isNull(), F.struct(moved(b, b["p"]).alias("pend"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(block, zero, step)


def rounded(units: DataFrame) -> DataFrame:
    """hash, doc_id, size, source, add for units (source, size, hash, doc_id, p) with 0 < p < 1."""
    id_type = dict(units.dtypes)["doc_id"]
    blocks = 1 << max(0, math.ceil(math.log2(max(1.0, units.count() / (2 * FAN_IN)))))
    levels = [(blocks, 1)]
    while blocks > 1:
        blocks = max(1, blocks // FAN_IN)
        levels.append((blocks, 1))
    levels += [(1, 8), (1, 1 << 20)]
    now = units.select("source", F.floor(4 * F.log2("size")).cast("int").alias("cls"),
                       "size", "hash", "doc_id", "p")
    settled = []
    for level, (blocks, width) in enumerate(levels):
        block = F.array_sort(F.collect_list(F.struct("size", "hash", "doc_id", "p")))
        met = (now.groupBy("source", F.floor(F.col("cls") / width).cast("int").alias("cls"),
                           F.pmod("hash", F.lit(blocks)).alias("blk"))
               .agg(block.alias("block"))
               .select("source", (F.col("cls") * width).alias("cls"), settle(F.col("block"), level, id_type).alias("s")))
        met = staged(met, f"mix-level{level}")
        settled.append(met.select("source", F.explode("s.done").alias("d")).select("source", "d.*"))
        now = met.select("source", "cls", "s.pend.*")
    settled.append(now.select("source", "hash", "doc_id", "size",
                              (uniform(F.lit(SEED), F.lit("root"), "hash", "doc_id") < F.col("p")).cast("int").alias("add")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def plan(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
         weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per distinct (doc_id, source, size): ``n`` rows of the input share ``copies``;
    with source_size and target."""
    sizes = staged(sized(df, doc_id, source, text), "mix-sizes")
    goal = targets(sizes, weights, cap).withColumnRenamed("source", "_s")
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = units.join(goal, units["source"].eqNullSafe(goal["_s"]), "left").drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("_e", F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0)))
    units = staged(units.select("doc_id", "source", "size", "n", "source_size", "target",
                                F.xxhash64(F.lit(SEED), "doc_id", "size").alias("hash"),
                                F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("p")), "mix-units")
    adds = rounded(units.where((F.col("p") > 0) & (F.col("p") < 1)))
    adds = adds.select(*[F.col(c).alias(f"_{c}") for c in ("hash", "doc_id", "size", "source")], "add")
    same = (units["hash"] == adds["_hash"]) & (units["size"] == adds["_size"])
    for c in ("doc_id", "source"):
        same = same & units[c].eqNullSafe(adds[f"_{c}"])
    return units.join(adds, same, "left").select(
        "doc_id", "source", "size", "n", "source_size", "target",
        (F.col("whole") + F.coalesce("add", F.lit(0))).alias("copies"))


def _share(row: Column) -> Column:
    """Copies of the row-th (from 1) of n equal rows."""
    return F.floor(F.col("copies") / F.col("n")) + (row <= F.pmod(F.col("copies"), F.col("n"))).cast("long")


def digest(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    out = plan(df, doc_id, source, text)
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_row"))
    return out.select(F.col("doc_id").alias(doc_id), "size", "source_size", "target",
                      (_share(F.col("_row")) * F.col("size")).cast("long").alias("taken"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed rows: every row as often as it is taken, columns unchanged."""
    counts = plan(df, doc_id, source, text).select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "n", "copies")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = ["_doc_id", "_source", "_size"]
    rows = df.select(F.struct("*").alias("_r"), F.col(doc_id).alias("_doc_id"), F.col(source).alias("_source"), words.alias("_size"))
    order = Window.partitionBy(*key).orderBy(F.xxhash64("_r"))
    numbered = rows.withColumn("_row", F.row_number().over(order))
    on = [numbered[c].eqNullSafe(counts[c]) for c in key]
    met = numbered.join(counts, on[0] & on[1] & on[2])
    times = met.select("_r", _share(F.col("_row")).cast("int").alias("_times")).where("_times > 0")
    return times.select("_r", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_r.*")
