"""SimHash near-duplicates: 64-bit fingerprints, a pigeonhole join on blocks, and linked classes.

A fingerprint's bit is 1 if it is set in over half of the text's shingle hashes (XXH64 of the
lower-cased words of ``words`` places in a row, repeats included). Fingerprints link at ``most`` or
fewer differing bits. Cut into ``most`` + 1 blocks, two linked fingerprints agree in one block at
least, so they meet under that block's bits; each meeting verifies the Hamming distance.

Equal fingerprints are one node, so copies cost nothing after the first aggregate. A crowded
meeting (more than ``CROWD`` nodes) is cut again: its remaining bits hold all differences, so they
are cut into ``most`` + 1 blocks in turn, as long as bits remain. What is still crowded is cut into
tiles, and every pair of tiles is compared. A meeting hands on a spanning forest of its links, not
all of them; no pair is dropped otherwise.

Defined results: null text and text without words have fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; rows without an id take the class of their
fingerprint (null if no row of the class has an id); rows with equal ids are separate; an empty
table gives no rows; other columns are ignored. Long texts are hashed piece by piece.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import ship_package
from .common import staged
from .components import components
from .jaccard_join import runs, sliced

WORDS, MOST, SEED = 3, 3, 42
BITS = 64
PIECE = 1 << 18  # bytes of a text that are hashed at a time
CROWD = 1_024  # nodes of a meeting that one task compares
DEPTH = 3  # cuts into blocks
SMALL = 32  # of a meeting whose pairs are compared together with those of others
BLANK = re.compile(rb"[ \t-\r]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by a space (of all words, if fewer)."""
    if not words:
        return np.zeros(0, np.uint64)
    data = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit (lowest first)."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = WORDS) -> int:
    data = text.translate(LOWER)
    count, total, at, carried = np.zeros(BITS, np.int64), 0, 0, []
    while at < len(data):
        edge = BLANK.search(data, at + PIECE)  # a piece ends with a word
        end = edge.start() if edge else len(data)
        words = carried + data[at:end].split()
        at = end
        if len(words) < size and at < len(data):
            carried = words
            continue
        if total and len(words) < size:
            break  # all their shingles are counted
        hashes = shingle_hashes(words, size)
        count += bit_counts(hashes)
        total += len(hashes)
        carried = words[len(words) - size + 1:]
    bits = np.packbits(2 * count > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """id and fingerprint (bigint with the 64 bits) of every row."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            marks = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["id", "fp"])

    docs = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, fp bigint")


# ---------------------------------------------------------------- blocks
def cut(bits: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    edge = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in itertools.pairwise(edge)]


def block_sets(depth: int, parts: int) -> list[tuple[tuple[int, ...], list]]:
    """(bits that agree, sets below) of the cuts: every set below adds a block of the rest."""
    def under(rest, level):
        found = []
        for block in cut(rest, parts):
            left = tuple(b for b in rest if b not in block)
            found.append((block, under(left, level + 1) if level < depth and len(left) >= parts else []))
        return found

    return under(tuple(range(BITS)), 1)


def masks(depth: int, parts: int) -> list[list[tuple[int, int]]]:
    """Per level, (mask, index of the mask above) of every set of bits that agree."""
    levels, now = [], [(0, -1, block_sets(depth, parts))]
    while now:
        below, masked = [], []
        for i, (mask, _, sets) in enumerate(now):
            for block, more in sets:
                whole = mask | sum(1 << b for b in block)
                masked.append((whole, i))
                below.append((whole, i, more))
        if masked:
            levels.append(masked)
        now = below
    return levels


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(masked: list[tuple[int, int]], above: bool) -> Column:
    """(m, v): the number of a mask and the fingerprint's bits under it. ``above``: only of masks
    below the row's own."""
    made = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")) for i, (mask, _) in enumerate(masked)]
    if not above:
        return F.array(*made)
    parents: dict[int, list] = {}
    for key, (_, parent) in zip(made, masked, strict=True):
        parents.setdefault(parent, []).append(key)
    out = F.lit(None)
    for parent, keys in parents.items():
        out = F.when(F.col("m") == parent, F.array(*keys)).otherwise(out)
    return out


def meetings(nodes: DataFrame, most: int = MOST, crowd: int = CROWD, depth: int = DEPTH) -> DataFrame:
    """(level, m, v, ta, tb, tile, fp): the meetings that may hold links."""
    found, now = None, nodes.select("fp")
    levels = masks(depth, most + 1)
    for level, masked in enumerate(levels):
        now = now.select("fp", F.explode(_keys(masked, level > 0)).alias("k")).select("fp", "k.m", "k.v")
        # counts by key are pre-aggregated; only keys where several meet go on
        size = staged(now.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
        last = level == len(levels) - 1
        crowded = F.lit(False) if last else F.col("n") > crowd
        now = staged(now.join(size, ["m", "v"]).withColumn("crowded", crowded), "simhash-met")
        ready = now.where("not crowded").withColumn("tiles", F.ceil(F.col("n") / crowd).cast("int")).withColumn(
            "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        ready = ready.select(F.lit(level).alias("level"), "m", "v", F.least("tile", "other").alias("ta"),
                             F.greatest("tile", "other").alias("tb"), "tile", "fp")
        found = ready if found is None else found.unionByName(ready)
        now = now.where("crowded").select("fp", "m")
        if last or now.isEmpty():
            return found
    return found


def forest(fp: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect whatever lies within ``most`` bits of each other; ``side`` 0 or 1
    each: only pairs of different sides (all 0: any pair). The search goes from node to node over
    those not reached yet."""
    two = bool(side.any())
    open_ = np.ones(len(fp), bool)
    a, b = [], []
    for start in range(len(fp)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            left = np.flatnonzero(open_ & (side != side[x])) if two else np.flatnonzero(open_)
            near = left[np.bitwise_count(fp[left] ^ fp[x]) <= most]
            open_[near] = False
            a += [x] * len(near)
            b += near.tolist()
            queue += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def links(met: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) of fingerprints: spanning forests of the meetings."""
    def run(batches):
        for t in runs(batches, 5):
            keys = [t.column(c).to_numpy() for c in ("level", "m", "v", "ta", "tb")]
            tile, fp = t.column("tile").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            new = np.ones(t.num_rows + 1, bool)
            new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            edge = np.flatnonzero(new)
            size = np.diff(edge)
            small = size <= SMALL
            until = np.repeat(edge[1:], size)  # where a row's meeting ends
            one = keys[3] == keys[4]
            out, i = [], np.flatnonzero(np.repeat(small, size))
            for step in range(1, SMALL):
                i = i[i + step < until[i]]
                j = i + step
                near = (np.bitwise_count(fp[i] ^ fp[j]) <= most) & (one[i] | (tile[i] != tile[j]))
                out.append((i[near], j[near]))
            for i, n in zip(edge[:-1][~small].tolist(), size[~small].tolist(), strict=True):
                side = np.where(keys[3][i] == keys[4][i], 0, tile[i:i + n] == keys[4][i]).astype(np.int8)
                a, b = forest(fp[i:i + n], side, most)
                out.append((a + i, b + i))
            a, b = (fp[np.concatenate(x)].view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    near = met.repartition("level", "m", "v", "ta", "tb").sortWithinPartitions("level", "m", "v", "ta", "tb", "fp")
    return near.select("level", "m", "v", "ta", "tb", "tile", "fp").mapInArrow(run, "a bigint, b bigint")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """id, fp and component_id of every row."""
    rows = staged(fingerprints(df, doc_id, text, words), "simhash-fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    root = components(links(meetings(nodes, most), most)).withColumnRenamed("v", "fp")
    placed = nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = staged(placed, "simhash-placed")
    named = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    ids = staged(lookup_join(placed, named, "root", "root").select("fp", "component_id"), "simhash-classes")
    return lookup_join(rows, ids, "fp", "fp")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    out = classes(df, doc_id, text)
    return out.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
