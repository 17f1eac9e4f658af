from collections import Counter, defaultdict

import pytest
from helpers import ROWS, empty, frame, words

from riskloom.llm import mixing


def brute_targets(sizes):
    """Shares by weight; sources above their cap are capped, and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > 3 * sizes[s]}
        if not over:
            return {s: t.get(s, 3.0 * sizes[s]) for s in names}
        capped |= over


def check(rows, got, slack):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    goal = brute_targets(sizes)
    source_of = {(i, len(words(t))): s for i, t, _, s in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _, _ in rows)
    taken = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s], rel=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= slack(rows, s), (s, taken[s], goal[s])


def test_every_case(spark):
    rows = [(i, t, lang, s) for i, t, lang, s in ROWS]
    largest = lambda rows, s: 2.0 * max(len(words(t)) for _, t, _, x in rows if x == s) + 1
    check(rows, mixing.digest(frame(spark, rows)).collect(), largest)
    assert mixing.digest(empty(spark)).collect() == []


def test_hot_source_capped_source_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 50), None, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    rows += [(10_000 + i, "tiny", None, "aa") for i in range(5)]
    df = frame(spark, rows)
    got = mixing.digest(df).collect()
    check(rows, got, lambda rows, s: 120)
    again = mixing.digest(df.repartition(13)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_repeated_rows_share_copies(spark):
    rows = [(1, "a b c d", None, "x")] * 9 + [(2, "a b c d", None, "y")] * 20
    got = mixing.digest(frame(spark, rows)).collect()
    check(rows, got, lambda rows, s: 4)
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(
        {i: n for i in (1, 2) if (n := sum(r["taken"] for r in got if r["doc_id"] == i) // 4)})


def test_mix_returns_rows_as_often_as_taken(spark):
    taken = {(r["doc_id"], r["size"]): 0 for r in mixing.digest(frame(spark)).collect()}
    for r in mixing.digest(frame(spark)).collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    out = Counter()
    for r in mixing.mix(frame(spark)).collect():
        assert r["_row"] == "r" and r["size"] == "z"
        out[r["doc_id"], len(words(r["text"]))] += len(words(r["text"]))
    assert out == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(empty(spark)).collect() == []
