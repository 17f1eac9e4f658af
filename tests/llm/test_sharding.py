import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import ROWS, empty, frame

from riskloom.llm import sharding


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def check(rows, expected):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["doc_id"]].add(r["shard"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_every_case(spark):
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    check(sharding.digest(frame(spark)).collect(), expected)


def test_a_key_with_a_third_of_all_rows(spark):
    rows = [(7, "same", None, None)] * 2000 + [(i, f"t{i}", None, None) for i in range(4000)]
    expected = Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _, _ in rows)
    got = sharding.digest(frame(spark, rows)).collect()
    check(got, expected)
    assert 100 < sum(r["grown_shard"] == 16 for r in got) < 400
    assert len(Counter(r["shard"] for r in got)) == 16


def test_empty_and_written_shards(spark, tmp_path):
    assert sharding.digest(empty(spark)).collect() == []
    sharding.write_shards(frame(spark), "doc_id", str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
