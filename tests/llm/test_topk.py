import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import topk


def brute(rows, k, every):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    out = set()
    for i, q in w:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in w if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id string")


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_matches_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(160)]
    rows += [(160, None), (161, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (162, [float("nan")] * 6), (180, [float("inf")] * 6),
             (None, [1.0] * 6), (200, []), (201, [0.0] * 6)]
    df = frame(spark, rows)
    expected = sorted(brute(rows, 5, 20))
    assert got(topk.digest(df, k=5)) == expected
    sparse = topk.sparse_rows(df, "vec_id", "embedding", lambda c: F.floor(F.lit(64.0) * c.cast("double")).cast("bigint"))
    many = topk.top_k(sparse.where("id % 20 = 0"), sparse, 5, query_block=3, candidate_block=10)
    assert got(many) == expected


def test_a_block_of_several_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4) / 8]) for i in range(240)]
    sparse = topk.sparse_rows(frame(spark, rows), "vec_id", "embedding", lambda c: F.floor(F.lit(64.0) * c.cast("double")).cast("bigint"))
    queries = sparse.where("id % 2 = 0")
    monkeypatch.setattr(topk, "QUERY_TILE", 7)
    assert got(topk.top_k(queries, sparse, 4, query_block=50, candidate_block=64)) == sorted(brute(rows, 4, 2))


def test_repeated_rows_few_candidates_and_empty(spark):
    df = frame(spark, [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])])
    assert got(topk.digest(df, k=20)) == [(0, 1, 1, 64 * 32), (0, 2, 1, 64 * 32)]
    assert got(topk.digest(frame(spark, []))) == []
    assert got(topk.digest(frame(spark, [(0, [1.0])]))) == []


def test_large_weights_do_not_overflow():
    q = np.array([np.array([0, 1])], object)
    big = np.empty(1, object)
    big[0] = np.array([3_000_000_000, 1])
    assert topk.accumulate(q, big, q, big)[0, 0] == 9 * 10**18 + 1
