"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: a list of (term, weight). Candidates are dealt into blocks of bounded size, and
so are queries; every query block meets every candidate block (a stated query set against all
rows). A query block is large, since every candidate is sent to each of them once; the task that
holds it takes it in tiles. For a tile and a block each term's postings (candidates with the term,
and their weights) are scattered, weighted by the tile's weights for that term, into a dense array
of scores, one row per candidate. Partition selection then leaves k candidates per query and block,
and a merge by rank leaves k per query.

Defined results: rows whose id or vector is null, or whose vector holds a null or a non-finite
component, take no part; an empty vector scores 0 with everything; rows with equal ids are
candidates of their own, but a query never meets a row of its own id; ties go to the smaller id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 8_192
QUERY_TILE = 512
SUB_BLOCK = 128


def sparse_rows(df: DataFrame, row_id: str, vector: str, weight=None) -> DataFrame:
    """id, terms, weights from a dense vector column: non-zero components after ``weight``."""
    x = F.col(vector)
    fits = F.col(row_id).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    weights = F.transform(x, weight or (lambda c: c.cast("bigint")))
    known = df.where(F.coalesce(fits, F.lit(False))).select(F.col(row_id).cast("bigint").alias("id"), weights.alias("w"))
    pairs = F.filter(F.transform(F.col("w"), lambda w, t: F.struct(t.alias("t"), w.alias("w"))), lambda p: p["w"] != 0)
    return known.select("id", pairs["t"].alias("terms"), pairs["w"].alias("weights"))


def _postings(terms: np.ndarray, weights: np.ndarray):
    """(terms present, bounds, rows, weights), sorted by term and row; a term that a row holds
    twice counts with the sum of its weights."""
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    if not len(rows):
        return rows, np.zeros(1, np.int64), rows, rows
    flat_t = np.concatenate([np.asarray(t, np.int64) for t in terms])
    flat_w = np.concatenate([np.asarray(w, np.int64) for w in weights])
    order = np.lexsort((rows, flat_t))
    flat_t, rows, flat_w = flat_t[order], rows[order], flat_w[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(flat_t) != 0) | (np.diff(rows) != 0))))
    flat_t, rows, flat_w = flat_t[new], rows[new], np.add.reduceat(flat_w, new)
    present, first = np.unique(flat_t, return_index=True)
    return present, np.append(first, len(flat_t)), rows, flat_w


def accumulate(q_terms, q_weights, c_terms, c_weights) -> np.ndarray:
    """Scores (candidate, query), one term after another: a term's postings are scattered into the
    score rows of their candidates, times the queries' weights for the term. Candidates go by
    sub-blocks, so that the score rows at hand stay in cache."""
    q_at, q_bounds, q_rows, q_w = _postings(q_terms, q_weights)
    most = max((len(t) for t in q_terms), default=0)
    top = [max((int(np.abs(np.asarray(w)).max()) for w in ws if len(w)), default=0) for ws in (q_weights, c_weights)]
    kind = np.int32 if top[0] * top[1] * max(most, 1) < 1 << 31 else np.int64
    lines = {}
    for j, term in enumerate(q_at):
        line = np.zeros(len(q_terms), kind)
        line[q_rows[q_bounds[j]:q_bounds[j + 1]]] = q_w[q_bounds[j]:q_bounds[j + 1]]
        lines[int(term)] = line
    scores = np.zeros((len(c_terms), len(q_terms)), kind)
    room = np.empty((SUB_BLOCK, len(q_terms)), kind)
    for a in range(0, len(c_terms), SUB_BLOCK):
        near = scores[a:a + SUB_BLOCK]
        at, bounds, rows, weights = _postings(c_terms[a:a + SUB_BLOCK], c_weights[a:a + SUB_BLOCK])
        weights = weights.astype(kind)
        for i, term in enumerate(at):
            line = lines.get(int(term))
            if line is not None:
                posted = slice(bounds[i], bounds[i + 1])
                n = posted.stop - posted.start
                np.multiply(weights[posted, None], line, out=room[:n])
                near[rows[posted]] += room[:n]
    return scores


def select_top(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int):
    """(query index, candidate index) of the k best candidates of every query; own id excluded."""
    order = np.argsort(c_ids, kind="stable")
    scores, c_ids = scores[order].T, c_ids[order]
    out_q, out_c = [], []
    for q, row in enumerate(scores):
        open_ = np.flatnonzero(c_ids != q_ids[q])
        row = row[open_]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            ties = np.flatnonzero(row == least)[: k - len(above)]  # ascending id
            best = np.concatenate([above, ties])
        else:
            best = np.arange(len(row))
        out_q.append(np.full(len(best), q))
        out_c.append(order[open_[best]])
    return (np.concatenate(out_q), np.concatenate(out_c)) if out_q else (np.zeros(0, int), np.zeros(0, int))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for sparse rows (id, terms, weights)."""
    ship_package(queries.sparkSession)
    queries = queries.dropDuplicates(["id", "terms", "weights"])  # equal query rows: one result
    n_q = max(1, -(-queries.select("id").count() // query_block))
    n_c = max(1, -(-candidates.select("id").count() // candidate_block))

    def blocks(df: DataFrame, own: Column, own_name: str, other: int, other_name: str) -> DataFrame:
        return df.select("id", "terms", "weights", F.xxhash64("id", "terms", "weights").alias("row"), own.cast("int").alias(own_name),
                         F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))

    def block(n: int) -> Column:  # equal ids are dealt by their vectors as well
        return F.pmod(F.xxhash64("id", "terms", "weights"), F.lit(n))

    left = blocks(queries, block(n_q), "qb", n_c, "cb")
    right = blocks(candidates, block(n_c), "cb", n_q, "qb")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        c_ids, c_terms, c_weights = c["id"].to_numpy(np.int64), c["terms"].to_numpy(), c["weights"].to_numpy()
        found = []
        for a in range(0, len(q), QUERY_TILE):
            tile = q.iloc[a:a + QUERY_TILE]
            q_ids = tile["id"].to_numpy(np.int64)
            scores = accumulate(tile["terms"].to_numpy(), tile["weights"].to_numpy(), c_terms, c_weights)
            iq, ic = select_top(scores, q_ids, c_ids, k)
            found.append(pd.DataFrame({"query_id": q_ids[iq], "row": tile["row"].to_numpy(np.int64)[iq], "vec_id": c_ids[ic],
                                       "score": scores[ic, iq].astype(np.int64)}))
        return pd.concat(found)

    met = (left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
           .applyInPandas(meet, "query_id bigint, row bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def digest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """Top k by inner product of floor(64 * x); queries are the rows whose id is divisible by ``every``."""
    rows = sparse_rows(df, vec_id, vector, lambda c: F.floor(F.lit(64.0) * c.cast("double")).cast("bigint"))
    return top_k(rows.where(F.col("id") % every == 0), rows, k)
