import numpy as np
import xxhash
from helpers import LONG, ROWS, empty, frame, words

from riskloom.llm import simhash as S


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(marks, most=3):
    """Smallest position's label per fingerprint, by all pairs."""
    marks = sorted(marks)
    label = {m: m for m in marks}
    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= most and label[a] != label[b]:
                old, new = label[b], label[a]
                label = {m: new if v == old else v for m, v in label.items()}
    return label


def expected(rows):
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    label = reach({m for _, m in marks})
    least = {}
    for i, m in marks:
        if i is not None:
            least[label[m]] = min(i, least.get(label[m], i))
    return sorted(((i, f"{m:016x}", least.get(label[m])) for i, m in marks), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_fingerprint_of_pieces_equals_the_whole(monkeypatch):
    text = (LONG[:5000] + "  \t one " + "x" * 300 + " two\n").encode()
    whole = S.fingerprint(text)
    assert whole == plain_fingerprint(text.decode())
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(S, "PIECE", piece)
        assert S.fingerprint(text) == whole
        for short in ("a", " a  b ", "a b c", "", " ", "Ä Ö ü É"):
            assert S.fingerprint(short.encode()) == plain_fingerprint(short)


def test_same_hash_as_the_built_in(spark):
    text = "ÉTÉ naïve 漢字 text"
    ours = spark.range(1).selectExpr(f"xxhash64('{text}') AS h").first()["h"]
    assert ours & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_every_case(spark):
    assert got(S.digest(frame(spark))) == expected([(r[0], r[1]) for r in ROWS])
    assert got(S.digest(empty(spark))) == []


def test_blocks_leave_no_pair_out():
    for depth in (1, 2, 3):
        sets = [m for m, _ in S.masks(depth, 4)[-1]]
        rng = np.random.default_rng(depth)
        for _ in range(300):
            bits = rng.choice(64, 3, replace=False)
            assert any(all(not m >> int(b) & 1 for b in bits) for m in sets)


def near_family(rng, centre, n, flips):
    return {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, flips + 1)), replace=False)) for _ in range(n)}


def test_meetings_cut_again_and_tiled_find_every_link(spark):
    """Large families around a few centres, so that meetings stay crowded after every cut."""
    rng = np.random.default_rng(5)
    marks = set()
    for _ in range(3):
        marks |= near_family(rng, int(rng.integers(0, 1 << 63)), 300, 9)
    marks |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    nodes = spark.createDataFrame([(S.signed(m),) for m in marks], "fp bigint")
    label = reach(marks)
    for crowd, depth in ((8, 3), (40, 2), (64, 1), (2000, 3)):
        pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in S.links(S.meetings(nodes, crowd=crowd, depth=depth)).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        mine = {m: m for m in marks}

        def root(m, mine=mine):
            while mine[m] != m:
                m = mine[m]
            return m

        for a, b in pairs:
            mine[root(a)] = root(b)
        classes = {}
        for m in marks:
            classes.setdefault(root(m), set()).add(m)
        want = {}
        for m, v in label.items():
            want.setdefault(v, set()).add(m)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_large_meetings_hand_on_a_forest(spark):
    fp = np.array(sorted(near_family(np.random.default_rng(6), 0, 500, 1)), np.uint64)
    a, b = S.forest(fp, np.zeros(len(fp), np.int8), 3)
    assert len(a) == len(fp) - 1


def test_documents_of_a_table_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(S.digest(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_text_in_a_third_of_all_rows(spark):
    rows = [(i, "one text that is everywhere in this table" if i % 3 else f"another text {i} of its own kind", "en", "a") for i in range(900)]
    assert got(S.digest(frame(spark, rows))) == expected([(r[0], r[1]) for r in rows])
