import base64
import hashlib
import struct

import xxhash
from helpers import ROWS, empty, frame
from pyspark.sql import functions as F

from riskloom.llm import fingerprint as P

import re


def long_hash(value, seed):
    h = xxhash.xxh64(struct.pack("<q", value), seed=seed & (2**64 - 1)).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text, k=P.K):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    out = set()
    for part in [h[i:i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h] if h else []:
        seed = 42
        for x in part:
            seed = long_hash(x, seed)
        out.add(seed)
    return sorted(out)[:k]


def printed(sketch):
    return base64.b64encode(b"".join(struct.pack(">q", x) for x in sketch)).decode()


def alike(a, b, k=P.K):
    u = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in u) / len(u) if u else 1.0


def count(a, k=P.K):
    return len(a) if len(a) < k else (k - 1) / ((a[-1] + 2.0**63) / 2.0**64)


def kept(a, b, k=P.K):
    u = sorted(set(a) | set(b))[:k]
    return min(1.0, alike(a, b, k) * count(u, k) / count(a, k)) if a else 1.0


def test_matches_brute_force(spark):
    rows = [(i, t or "") for i, t, _, _ in ROWS if i is not None]
    rows.sort()
    expected = set()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 4
        e = t[:len(t) - cut] + nxt[:cut]
        a, b, c = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        expected.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), printed(a), printed(b), round(alike(a, b), 9), round(alike(a, c), 9),
                      round(count(a), 6), round(kept(a, b), 9), round(kept(a, c), 9)))
    got = P.digest(frame(spark)).where("doc_id is not null").collect()
    assert len(got) == len(rows)
    assert {(*r[:5], round(r[5], 9), round(r[6], 9), round(r[7], 6), round(r[8], 9), round(r[9], 9)) for r in got} == expected


def test_order_is_kept_across_buckets(spark):
    rows = [(i * 3, f"text {i} " * (1 + i % 7), None, None) for i in range(3500)]
    got = {r["doc_id"]: r["edited_sha256"] for r in P.digest(frame(spark, rows)).collect()}
    for n, (i, t, _, _) in enumerate(rows):
        cut = len(t) // 4
        nxt = rows[(n + 1) % len(rows)][1]
        assert got[i] == hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()


def test_rows_without_id_and_empty_table(spark):
    rows = [(None, "one two three four five six", None, None), (None, None, None, None)]
    got = P.digest(frame(spark, rows)).collect()
    assert len(got) == 2 and {r["n_chars"] for r in got} == {0, 27}
    assert P.digest(empty(spark)).collect() == []


def test_parts_merge_and_estimates(spark):
    a = [f"w{i}" for i in range(3000)]
    text = {"all": a, "left": a[:2000], "right": a[1996:], "half": a[:1500]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in text.items()], "k string, t string")
    df = df.withColumn("h", P.word_hashes(F.col("t"))).select("k", P.bottom(P.shingle_hashes(F.col("h"))).alias("s"))
    s = {r["k"]: r["s"] for r in df.collect()}
    one = spark.createDataFrame([(s["all"], s["left"], s["right"], s["half"])], "a array<bigint>, l array<bigint>, r array<bigint>, h array<bigint>")
    m, n, j, c = one.select(P.merge(F.col("l"), F.col("r")), P.distinct_shingles(F.col("a")),
                            P.resemblance(F.col("a"), F.col("h")), P.containment(F.col("h"), F.col("a"))).collect()[0]
    assert m == s["all"] and abs(n - 2996) < 600 and abs(j - 0.5) < 0.15 and c > 0.8
    grouped = P.sketch_of_group(df.where("k in ('left', 'right')").withColumn("g", F.lit(1)), ["g"], "s").collect()
    assert grouped[0]["s"] == s["all"]
