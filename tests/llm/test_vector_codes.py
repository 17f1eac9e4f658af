import hashlib

import numpy as np
import pytest

from riskloom.llm import vector_codes as V


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, label, code, error) rows and the codebooks' hash, by plain distances in Python integers."""
    rows = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = -(-max((len(r[2]) for r in rows), default=0) // parts)
    cut = [[(r[2] + [0] * (parts * length - len(r[2])))[p * length:(p + 1) * length] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(c[p][i] for c, o in zip(cut, of, strict=True) if o == k) // of.count(k) for i in range(length)]
                        if of.count(k) else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    numbers = ",".join(str(x) for b in books for e in b for x in e)
    coded = [(r[0], r[1], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(rows, found, strict=True)]
    return coded, hashlib.sha256(numbers.encode()).hexdigest()


def expected(rows):
    coded, sha = brute(rows)
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, error, total[label], sha) for i, label, code, error in coded), key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "c", "e") for i, v, label in rows],
                                 f"vec_id bigint, embedding array<{kind}>, label int, code string, error string")


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_transform_keeps_distances_and_orders_by_sign_changes():
    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 8, 16):
        x, y = rng.integers(-300, 300, (2, size))
        far = ((V.transform(x[None]) - V.transform(y[None])) ** 2).sum()
        assert far == size * ((x - y) ** 2).sum()
        rows = V.transform(np.eye(size, dtype=np.int64)).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(size))
    assert V.transformed(np.array([[1, 2, 3]])).shape == (1, 4)


@pytest.mark.parametrize("big", [False, True])
def test_nearest_is_exact_with_ties(big):
    rng = np.random.default_rng(2)
    for length in (1, 3, 4, 6):
        x, c = rng.integers(-4, 5, (300, length)), rng.integers(-4, 5, (40, length))
        x, c = (x.astype(object) * 10**12, c.astype(object) * 10**12) if big else (x, c)
        index, far = V.nearest(V.transformed(V.exact(x, c)), V.transformed(V.exact(c, x)))
        plain = np.array([[int(((a - b) ** 2).sum()) for b in c] for a in x], object)
        assert index.tolist() == [list(r).index(min(r)) for r in plain]
        size = 1 << (length - 1).bit_length()
        assert far.tolist() == [size * min(r) for r in plain]


def test_matches_brute_force_with_bad_rows_ties_and_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 32).astype("f4")], int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(i, rows[5][1], 1) for i in range(150, 200)]  # copies
    rows += [(7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[3][1], 0), (300, None, 0), (301, [1.0, None] + [0.0] * 30, 0),
             (302, [float("nan")] * 32, 0), (303, [float("inf")] * 32, 0), (304, [-float("inf")] + [0.0] * 31, 1)]
    assert got(V.digest(frame(spark, rows))) == expected(rows)


def test_few_rows_odd_lengths_and_empty(spark):
    assert got(V.digest(frame(spark, []))) == []
    rows = [(3, [0.5, -0.25, 1.0], 1), (1, [0.1], None), (2, [], None)]
    assert got(V.digest(frame(spark, rows))) == expected(rows)
    assert got(V.digest(frame(spark, [(1, [], None)]))) == expected([(1, [], None)])


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(x) for x in (i * 2.0**33, -i, 2.0**20)], 0) for i in range(70)]
    out = {r[0]: r for r in got(V.digest(frame(spark, rows, "double")))}
    want = {r[0]: r for r in expected(rows)}
    assert {i: (r[1], r[4]) for i, r in out.items()} == {i: (r[1], r[4]) for i, r in want.items()}
    assert all(out[i][2] == min(V.LONG, want[i][2]) for i in out)


def test_decoded_vectors_have_the_error(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 32)], 0) for i in range(100)]
    df = frame(spark, rows, "double")
    coded, books = V.compress(df)
    kept = {r["id"]: r for r in V.decode(coded, books).collect()}
    for i, v, _ in rows:
        back = np.array(kept[i]["vector"]) * 256
        assert ((np.floor(256 * np.array(v)) - back) ** 2).sum() == kept[i]["error"]
