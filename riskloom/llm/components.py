"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MOST_ROUNDS = 200


def _ordered(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b bigint; a link from a vertex to itself only
    names it). Each round every vertex moves to the smallest of itself and its neighbours in a
    random but fixed order, and links between different places go to the next round. Minima are
    pre-aggregated, so a vertex with a third of all links is no special case; every round is
    written to the shared folder."""
    now = staged(links.select("a", "b").distinct(), "cc-links")
    places: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_ordered("b")).alias("m"))
        step = staged(best.select(F.col("a").alias("v"), F.least(F.col("m"), _ordered("a"))["v"].alias("p")), "cc-step")
        if places is None:
            places = step.withColumnRenamed("p", "root")
        else:
            places = staged(places.join(step.withColumnRenamed("v", "root"), "root", "left")
                            .select("v", F.coalesce("p", "root").alias("root")), "cc-places")
        moved = (now.where("a != b").join(step.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
                 .join(step.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b").where("pa != pb"))
        now = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-links")
        if now.isEmpty():
            return places
    raise RuntimeError(f"components: links remain after {MOST_ROUNDS} rounds")
