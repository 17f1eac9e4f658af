"""The pipeline's near-copy stage against comparisons of every pair."""
import random
from collections import Counter, defaultdict

import corpus_pipeline as C
from helpers import frame, words

SF = "/root/testdata/sf0.01"


def first_of_each(rows, size, least):
    """Ids that are the smallest of their class, by comparing every pair of (id, text) that shares a shingle."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for m, common in Counter(m for x in s for m in post[x]).items():
            if 100 * common >= least * (len(s) + len(sets[m][1]) - common):
                a, b = sorted((find(sets[n][0]), find(sets[m][0])))
                parent[b] = a
        for x in s:
            post[x].append(n)
    return sorted(i for i in parent if find(i) == i)


def edited(n, edits, size, seed, first):
    """Texts of ``size`` words with up to ``edits`` of them replaced."""
    rng = random.Random(seed)
    base = [f"b{seed}x{rng.randrange(500)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w), None, None))
    return out


def test_near_copy_stage_matches_brute_force(spark):
    """Shingles of five words, 0.8 or more: on real documents, and on edited copies around that limit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = edited(40, 3, 60, 1, 0) + edited(40, 8, 120, 2, 1000) + edited(25, 30, 400, 3, 2000)
    made += [(3000, "a b c d e f", None, None), (3001, "a b c d e g", None, None), (3002, "a b", None, None), (3003, "A  b", None, None)]
    for df in (docs, frame(spark, made)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        kept = first_of_each(rows, 5, 80)
        assert kept != first_of_each(rows, 3, 90)
        assert sorted(r["doc_id"] for r in C.drop_near_copies(spark, df, SF).collect()) == kept


def test_one_id_on_several_texts_and_repeated_rows(spark):
    """Rows are chosen by id and class: a copy does not stay because its id is the first of another class."""
    t, u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuv")
    rows = [(2, t), (5, t), (5, u), (5, u), (6, u.upper()), (7, v), (7, v + " end"), (8, v), (9, ""), (9, None), (9, None), (None, t), (None, None)]
    out = C.drop_near_copies(spark, frame(spark, [(i, x, "en", None) for i, x in rows]), SF).collect()
    got = Counter((r["doc_id"], (r["text"] or "").split()[:1] == ["v0"] or r["text"]) for r in out)
    assert got == Counter([(2, t), (5, u), (7, True), (9, ""), (9, None), (9, None), (None, t), (None, None)])


def test_a_row_that_is_a_third_of_the_table(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t, "en", "a")] * 300 + [(1, f"only {i} of its own kind here", "en", "a") for i in range(300)] + [(2000 + i, t, "en", "b") for i in range(300)]
    out = C.drop_near_copies(spark, frame(spark, rows), SF).collect()
    assert Counter(r["text"] for r in out) == Counter({t: 1} | {f"only {i} of its own kind here": 1 for i in range(300)})
