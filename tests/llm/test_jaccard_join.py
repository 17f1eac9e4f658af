import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ROWS, empty, frame, words

from riskloom.llm import jaccard_join as J
from riskloom.llm.components import components


def brute(rows):
    """(id, set size, class id) by comparing every pair of distinct sets."""
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])))
    parent = {s: s for _, s in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    named = {s for i, s in sets if i is not None and s}
    post, order = defaultdict(list), sorted(named, key=sorted)
    for a in order:
        common = defaultdict(int)
        for x in a:
            for b in post[x]:
                common[b] += 1
            post[x].append(a)
        for b, n in common.items():
            if 100 * n >= 90 * (len(a) + len(b) - n):
                parent[find(a)] = find(b)
    least = {}
    for i, s in sets:
        if i is not None and s:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, len(s), least.get(find(s), i) if s else i) for i, s in sets), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_every_case(spark):
    assert got(J.digest(frame(spark))) == brute(ROWS)
    assert J.digest(empty(spark)).collect() == []


def near_copies(n, edits, size, seed, first):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(500)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w), None, None))
    return out


@pytest.fixture(scope="module")
def crowded():
    """Copies, groups of near copies of different closeness, and unrelated texts with one passage."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = near_copies(150, 3, 60, 1, 0) + near_copies(120, 6, 90, 2, 1000) + near_copies(60, 30, 700, 3, 2000)
    rows += [(3000 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))), None, None) for i in range(300)]
    rows += [(4000 + i, "exactly the same five words", None, None) for i in range(300)]
    rng.shuffle(rows)
    return rows


def test_crowded_table(spark, crowded):
    assert got(J.digest(frame(spark, crowded))) == brute(crowded)


def test_tiles_change_nothing(spark, crowded, monkeypatch):
    for name, value in (("TILE", 40), ("TILE_SHINGLES", 4000), ("SMALL", 4), ("FREQUENT", 16)):
        monkeypatch.setattr(J, name, value)
    assert got(J.digest(frame(spark, crowded))) == brute(crowded)


def test_one_of_each_keeps_whole_rows(spark):
    kept = J.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, None, None]))
    assert J.one_of_each(empty(spark)).collect() == []


def test_bitmap_distance_never_exceeds_difference():
    rng = np.random.default_rng(2)
    for n in (1, 100, 300, 2000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
        bits = J.Bitmaps([J.bitmap(a).tobytes(), J.bitmap(b).tobytes()])
        far = bits.distance(np.array([0]), np.array([1]))[0]
        assert far <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)]
    links += [(2000 + rng.randrange(100), 2000 + rng.randrange(100)) for _ in range(60)]
    out = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    root = {r["v"]: r["root"] for r in out}
    assert len(out) == len(root) == len({x for link in links for x in link})
    assert all(root[a] == root[b] for a, b in links)
    parent = {x: x for x in root}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    assert len(set(root.values())) == len({find(x) for x in root})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
