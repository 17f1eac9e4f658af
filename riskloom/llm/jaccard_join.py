"""N-gram Jaccard join: grouped prefix join over word shingle sets, and the classes it links.

A text's set holds the hashes of its distinct shingles of ``words`` words. Two texts link when
least[1] * |intersection| >= least[0] * |union|. The defaults are op7's contract: three words, 90/100.

1. Shingles that are frequent within blocks of texts are ranked last; the others go by hash. Any
   fixed order gives right results; this one keeps frequent shingles out of the prefixes.
2. Per text: set size, hash of the set, the prefix (linked sets must share a shingle of it), and a
   parity bitmap of the set (its distance to another bitmap never exceeds the sets' difference).
3. Equal sets become one node, nodes of equal prefix and size one group.
4. Groups meet at shared prefix shingles. Pairs are filtered by size and bitmap, and each meeting
   hands on a spanning forest of the pairs that pass, not all of them. Large meetings are cut
   into tiles, and every pair of tiles is a task's work.
5. Groups that hang together are expanded: their nodes' texts come together (again in tiles when
   they are many) and are verified by exact intersection counts. The search runs from text to
   text over those not reached yet, so a clique costs about one look per member.
6. The verified links' components are the classes; a class's id is its smallest document id.

No pair of a group is dropped; pairs that are already linked through others are not looked at.

Defined results: null text, and text without words, has an empty set and links with nothing; a text
of fewer words than a shingle is one shingle; rows without an id get the id of the class of their set if
other rows have that set (else null) and link nothing themselves; rows with equal ids are separate;
an empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import staged
from .components import components
from .textnp import U, Words, batches, mix

WORDS = 3
LEAST = (90, 100)  # least similarity, as a fraction
FREQUENT = 1 << 16  # shingles that are ranked last; an order, not a limit on results
FREQUENT_SHARE = 0.001  # of a block's texts
BLOCK_SHINGLES = 2_000_000
TILE = 2_048  # groups of one meeting, or nodes of one verification, that a task compares
TILE_SHINGLES = 1_000_000
SMALL = 32


def shingle_sets(texts: list[bytes], words: int = WORDS):
    """The sorted set of shingle hashes of every text."""
    w = Words(texts)
    h = w.hashes()
    n = len(h)
    code = np.zeros(max(0, n - words + 1), U)
    for k in range(words):
        code = mix(code + h[k:n - words + 1 + k] + U(k + 1)) if n >= words else code
    first = w.first.tolist()
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        if b - a >= words:
            yield np.unique(code[a:b - words + 1])
        elif b > a:
            short = np.zeros(1, U)
            for k in range(a, b):
                short = mix(short + h[k:k + 1] + U(k - a + 101))
            yield short
        else:
            yield np.zeros(0, U)


def set_hash(s: np.ndarray) -> int:
    """Of a sorted set that is not empty; equal for equal sets."""
    place = np.arange(1, len(s) + 1, dtype=U)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s * U(0x9E3779B97F4A7C15) + place)) + U(len(s))], U)).view(np.int64)[0])


def set_hashes(text: Column, words: int = WORDS) -> Column:
    """The set hash of every text; null without words."""
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        data = [t.encode() for t in texts.fillna("")]
        return pd.Series([set_hash(s) if len(s) else None for i, j in batches(data) for s in shingle_sets(data[i:j], words)],
                         dtype="Int64")

    return run(text)


def prefix_size(n: int, least=LEAST) -> int:
    return n - -(-least[0] * n // least[1]) + 1 if n else 0


def most_difference(total: np.ndarray, least=LEAST) -> np.ndarray:
    """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
    return total - 2 * -(-least[0] * total // (least[0] + least[1]))


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity of the number of values per bit; between n / 2 and n bits, at least 64."""
    n = max(1, len(values))
    size = 64 << max(0, int(np.ceil(np.log2(n / 128))))
    ones = np.bincount((values & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<u8")


def frequent_shingles(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Hashes of frequent shingles, most frequent last. Each block of texts names those in at least
    FREQUENT_SHARE of its texts (a shingle that frequent overall is so in some block)."""
    def run(parts):
        sets, size = [], 0

        def settle():
            key, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= max(2.0, FREQUENT_SHARE * len(sets))
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

        for batch in parts:
            data = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j in batches(data):
                for s in shingle_sets(data[i:j], words):
                    sets.append(s)
                    size += len(s)
                if size > BLOCK_SHINGLES:
                    yield settle()
                    sets, size = [], 0
        if size:
            yield settle()

    level = F.floor(8 * F.log2("n")).cast("int")
    found = staged(texts.mapInArrow(run, "h bigint, n bigint").groupBy("h")
                   .agg(F.sum("n").cast("double").alias("n")).withColumn("level", level), "join-frequent")
    # the lowest level from which on at most FREQUENT shingles lie: a few hundred rows tell it, and
    # only those shingles come to the driver, whatever the number of tasks
    cut, held = None, 0
    for r in sorted(found.groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        cut = r["level"]
    top = [] if cut is None else sorted((r["n"], r["h"]) for r in found.where(F.col("level") >= cut).collect())
    return np.array([h for _, h in top], np.int64).view(U)


def signatures(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, least=LEAST) -> DataFrame:
    """id, n, node (hash of the set), gkey (hash of prefix and size), prefix, bits."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most FREQUENT numbers

    def run(parts):
        keys, rank = shared.value
        for batch in parts:
            data = batch.column(1).cast(pa.binary()).to_pylist()
            rows = []
            for i, j in batches(data):
                for s in shingle_sets(data[i:j], words):
                    n = len(s)
                    if not n:
                        rows.append((0, 0, 0, [], b""))
                        continue
                    size = prefix_size(n, least)
                    at = np.searchsorted(keys, s)
                    often = np.zeros(n, bool)
                    inside = at < len(keys)
                    often[inside] = keys[at[inside]] == s[inside]
                    rare = s[~often][:size]
                    if len(rare) < size:
                        last = s[often][np.argsort(rank[at[often]])]
                        rare = np.concatenate([rare, last[:size - len(rare)]])
                    place = np.arange(1, n + 1, dtype=U)
                    head = mix(np.array([np.bitwise_xor.reduce(mix(rare + place[:size])) + U(n)], U))
                    rows.append((n, set_hash(s), int(head.view(np.int64)[0]),
                                 rare.view(np.int64), bitmap(s).tobytes()))
            n, node, gkey, prefix, bits = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(gkey, pa.int64()),
                 pa.array(list(prefix), pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["id", "n", "node", "gkey", "prefix", "bits"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n int, node bigint, gkey bigint, prefix array<bigint>, bits binary")


RUN_BYTES = 4 << 20


def sliced(parts):
    """The parts' rows in slices of about a megabyte."""
    for batch in parts:
        step = max(1, (batch.num_rows << 20) // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def runs(parts, key_columns: int):
    """Tables of whole runs: rows sorted by the first columns, never split between two tables, in
    pieces of a few thousand rows or megabytes (or one run)."""
    held = []
    for batch in sliced(parts):
        held.append(batch)
        if sum(b.num_rows for b in held) < 20_000 and sum(b.nbytes for b in held) < RUN_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(k).to_numpy() for k in range(key_columns)]
        same = np.ones(t.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def groups(nodes: DataFrame) -> DataFrame:
    """gkey, n, prefix, bits of the first node, rho (largest bitmap distance from it to the group's
    other nodes) and how many nodes. Streams over the sorted nodes: no group is held."""
    def run(parts):
        now = None
        for batch in parts:
            out = []
            for gkey, node, n, prefix, bits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now[0] != gkey:
                    if now:
                        out.append(now)
                    now = [gkey, n, prefix, bits, 0, 1, node]
                elif node != now[6]:
                    far = int(np.bitwise_count(np.frombuffer(bits, "<u8") ^ np.frombuffer(now[3], "<u8")).sum())
                    now[4], now[5], now[6] = max(now[4], far), now[5] + 1, node
            if out:
                yield table(out)
        if now:
            yield table([now])

    def table(rows):
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)],
                                          names=["gkey", "n", "prefix", "bits", "rho", "nodes"])

    first = nodes.groupBy("gkey", "node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    spread = first.repartition("gkey").sortWithinPartitions("gkey", "node")
    return spread.mapInArrow(run, "gkey bigint, n int, prefix array<bigint>, bits binary, rho int, nodes bigint")


class Bitmaps:
    """Bitmaps of different sizes (powers of two), and distances of many pairs."""

    def __init__(self, blobs: list[bytes]):
        self.size = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(blobs), "<u8")

    def _rows(self, i, size, to):
        m = self.data[self.at[i][:, None] + np.arange(size)]
        while m.shape[1] > to:  # folding adds up parities
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2:]
        return m

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        a, b = self.size[i], self.size[j]
        for key in np.unique(a * (1 << 32) + b).tolist():
            sa, sb = key >> 32, key & ((1 << 32) - 1)
            mine = np.flatnonzero((a == sa) & (b == sb))
            to = min(sa, sb)
            for s in range(0, len(mine), 50_000):
                p = mine[s:s + 50_000]
                out[p] = np.bitwise_count(self._rows(i[p], sa, to) ^ self._rows(j[p], sb, to)).sum(axis=1)
        return out


def near_pairs(key: np.ndarray, n: np.ndarray, rho: np.ndarray, bits: Bitmaps, side: np.ndarray, least=LEAST):
    """Pairs (i, j) of one key that sizes and bitmaps allow; rows are sorted by key and n. Yields
    arrays, nearer neighbours in the order first. ``side``: pairs of different non-zero sides only
    (0: any)."""
    i = np.arange(len(key))
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(key)]
        j = i + step
        ok = (key[i] == key[j]) & (least[1] * n[i].astype(np.int64) >= least[0] * n[j].astype(np.int64))
        i, j = i[ok], j[ok]
        if not len(i):
            return
        cross = (side[i] == 0) | (side[i] != side[j])
        a, b = i[cross], j[cross]
        most = most_difference((n[a] + n[b]).astype(np.int64), least) + rho[a] + rho[b]
        near = bits.distance(a, b) <= most
        yield a[near], b[near]


def candidate_links(entries: DataFrame, least=LEAST) -> DataFrame:
    """(a, b) group links: per meeting (token, ta, tb) a spanning forest of the pairs that pass."""
    def run(parts):
        for t in runs(parts, 3):
            cols = {c: t.column(c).to_numpy() for c in ("token", "ta", "tb", "n", "gkey", "rho", "tile")}
            new = np.ones(t.num_rows, bool)
            new[1:] = False
            for c in ("token", "ta", "tb"):
                new[1:] |= cols[c][1:] != cols[c][:-1]
            key = np.cumsum(new) - 1
            side = np.where(cols["ta"] == cols["tb"], 0, cols["tile"] + 1)
            blobs = t.column("bits").to_pylist()
            length = np.bincount(key)
            large = length[key] > SMALL
            out = []
            small = np.flatnonzero(~large)
            if len(small):
                for a, b in near_pairs(key[small], cols["n"][small], cols["rho"][small], Bitmaps([blobs[x] for x in small]), side[small], least):
                    out.append((small[a], small[b]))
            for k in np.flatnonzero(length > SMALL).tolist():
                mine = np.arange(np.searchsorted(key, k), np.searchsorted(key, k, side="right"))
                label = np.arange(len(mine))
                for a, b in near_pairs(key[mine], cols["n"][mine], cols["rho"][mine], Bitmaps([blobs[x] for x in mine]), side[mine], least):
                    apart = label[a] != label[b]
                    for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                        if label[x] != label[y]:
                            label[label == label[y]] = label[x]
                            out.append((mine[[x]], mine[[y]]))
            if out:
                a, b = (np.concatenate(s) for s in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols["gkey"][a]), pa.array(cols["gkey"][b])], names=["a", "b"])

    near = entries.repartition("token", "ta", "tb").sortWithinPartitions("token", "ta", "tb", "n", "gkey")
    return near.select("token", "ta", "tb", "n", "gkey", "rho", "tile", "bits").mapInArrow(run, "a bigint, b bigint")


def linked(sets: list[np.ndarray], least=LEAST) -> np.ndarray:
    """Label (index of a member) per set: components of the exact links."""
    size = np.array([len(s) for s in sets], np.int64)
    label = np.full(len(sets), -1)
    owner = np.repeat(np.arange(len(sets)), size)
    token, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))

    def postings(open_):
        keep = np.flatnonzero(open_[owner])
        order = keep[np.argsort(flat[keep], kind="stable")]
        return owner[order], np.searchsorted(flat[order], np.arange(len(token) + 1))

    open_ = np.ones(len(sets), bool)
    who, bounds = postings(open_)
    indexed = len(sets)
    for start in np.argsort(-size, kind="stable").tolist():
        if not open_[start]:
            continue
        open_[start] = False
        label[start] = start
        queue = [start]
        while queue:
            x = queue.pop()
            left = int(open_.sum())
            if not left:
                break
            if left * 2 < indexed:
                (who, bounds), indexed = postings(open_), left
            mine = flat[begin[x]:begin[x + 1]]
            a, n = bounds[mine], bounds[mine + 1] - bounds[mine]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            common = np.bincount(who[at], minlength=len(sets))
            union = size + size[x] - common
            near = np.flatnonzero(open_ & (common > 0) & (least[1] * common >= least[0] * union))
            open_[near] = False
            label[near] = start
            queue += near.tolist()
    return label


def verified_links(texts: DataFrame, words: int = WORDS, least=LEAST) -> DataFrame:
    """(a, b) node links inside (comp, ta, tb): a star per component of exact links."""
    def run(parts):
        for t in runs(parts, 3):
            comp, ta, tb = (t.column(c).to_numpy() for c in ("comp", "ta", "tb"))
            node = t.column("node").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(comp) != 0) | (np.diff(ta) != 0) | (np.diff(tb) != 0), [True])))
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                seen, sets, names = set(), [], []
                data = t.column("text").slice(a, b - a).cast(pa.binary()).to_pylist()
                for i, j in batches(data):
                    for k, s in enumerate(shingle_sets(data[i:j], words), a + i):
                        # rows of the same id with another text came along: not this node
                        if len(s) and set_hash(s) == node[k] and node[k] not in seen:
                            seen.add(node[k])
                            sets.append(s)
                            names.append(node[k])
                if len(sets) > 1:
                    label = linked(sets, least)
                    names = np.array(names)
                    far = np.flatnonzero(label != np.arange(len(label)))
                    out.append((names[label[far]], names[far]))
            if out:
                x, y = (np.concatenate(s) for s in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    near = texts.repartition("comp", "ta", "tb").sortWithinPartitions("comp", "ta", "tb", "node")
    return near.select("comp", "ta", "tb", "node", "text").mapInArrow(run, "a bigint, b bigint")


def tiled(df: DataFrame, tiles, name: str) -> DataFrame:
    """Add ``tile`` (by the hash of ``name``), and one row per pair (ta <= tb) of tiles with it."""
    df = df.withColumn("_tiles", tiles.cast("int")).withColumn("tile", F.pmod(F.xxhash64(name), F.col("_tiles")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return df.withColumn("ta", F.least("tile", "_other")).withColumn("tb", F.greatest("tile", "_other")).drop("_tiles", "_other")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least=LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, set_hash (equal for equal sets) and class_hash (equal for
    linked sets; component_id is too, but repeated ids may share it) of every row."""
    ship_package(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frequent = frequent_shingles(docs.select("text"), words)
    rows = staged(signatures(docs, frequent, words, least), "join-signatures")

    group = staged(groups(rows.where("n > 0").select("gkey", "node", "n", "prefix", "bits")), "join-groups")
    token = group.select("gkey", F.explode("prefix").alias("token"))
    shared = (token.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1"))
    entries = shared.join(group.select("gkey", "n", "rho", "bits"), "gkey")
    entries = tiled(entries, F.ceil(F.col("df") / TILE), "gkey")
    several = group.where("nodes > 1").select(F.col("gkey").alias("a"), F.col("gkey").alias("b"))
    loose = components(candidate_links(entries, least).union(several))

    node = rows.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("gkey").alias("gkey"), F.first("n").alias("n"))
    node = staged(node, "join-nodes")
    member = staged(node.where(F.col("id").isNotNull()).join(loose.select(F.col("v").alias("gkey"), F.col("root").alias("comp")), "gkey")
                    .select("node", "id", "n", "comp"), "join-members")
    sizes = member.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).where("m > 1")
    member = member.join(sizes, "comp")
    member = tiled(member, F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)), "node")
    # by sorted shuffles at every size: the members grow with the input
    texts = docs.join(member.select("id", "node", "comp", "ta", "tb").hint("merge"), "id")
    link = staged(verified_links(texts, words, least), "join-links")

    root = components(link).withColumnRenamed("v", "node")
    met = node.join(root, "node")
    named = met.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = met.select("node", "root").join(named, "root").select("node", "root", "component_id")
    known = (node.where("copies > 1").select("node", F.col("id").alias("_own")).join(ids, "node", "full")
             .select("node", "root", F.coalesce("component_id", "_own").alias("component_id")))
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(known, "node", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("component_id", "id").alias("component_id"), F.col("node").alias("set_hash"),
                      F.coalesce("root", "node").alias("class_hash"))


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return classes(df, doc_id, text).drop("set_hash", "class_hash")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least=LEAST) -> DataFrame:
    """One row of every class, all columns: of the rows with the class's smallest id whose own set
    is in the class, one (the smallest by hash, if there are several). Rows without an id and rows
    without words stay."""
    own = classes(df, doc_id, text, words, least).where(F.col("set_hash").isNotNull() & (F.col(doc_id) == F.col("component_id")))
    found = own.groupBy("class_hash", "set_hash").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("id"))
    # an id with several texts of one class: the smallest set stands for the class
    first = F.min(F.struct(F.col("set_hash").alias("_set"), F.col("n").alias("_rows"), F.col("id").alias("_first"))).alias("k")
    kept = staged(found.groupBy("class_hash").agg(first).select("k.*"), "join-kept")
    rows = df.select(F.struct("*").alias("_r"), F.col(doc_id).alias("_id"), set_hashes(F.col(text), words).alias("_own"))
    met = rows.join(kept.where("_rows = 1"), (F.col("_id") == F.col("_first")) & (F.col("_own") == F.col("_set")), "left")
    out = met.where(F.col("_id").isNull() | F.col("_own").isNull() | F.col("_first").isNotNull()).select("_r.*")
    repeated = kept.where("_rows > 1")
    if not repeated.isEmpty():
        same = rows.join(repeated, (F.col("_id") == F.col("_first")) & (F.col("_own") == F.col("_set")))
        out = out.unionByName(same.groupBy("_first", "_set").agg(F.min_by("_r", F.xxhash64("_r")).alias("_r")).select("_r.*"))
    return out
