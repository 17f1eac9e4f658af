import re
from collections import Counter, defaultdict

from helpers import LONG, ROWS, ascii_lower, empty, frame

from riskloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, top=50):
    counts, files, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall(ascii_lower(text or "")))
        counts[lang, source].update(found)
        files[lang].update(found.keys())
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in files[lang].items() if n >= least]
        mine = sorted(s for la, s in groups if la == lang)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        shares, q = {s: p(counts[lang, s]) for s in mine}, p(whole)
        for s in mine:
            pair = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in mine if o != s]
            term = [(-(shares[s][t] - q[t]), t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -v, r) for r, (v, i) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms_of_bytes_and_pieces(monkeypatch):
    text = "The QUICK brown-fox's 3rd café\x00ÀÉ 漢字 tab\tend" + LONG[:2000]
    want = Counter(t.encode() for t in TERM.findall(ascii_lower(text)))
    assert D.term_counts(text.encode()) == want
    for piece in (1, 9, 100):
        monkeypatch.setattr(D, "PIECE", piece)
        assert D.term_counts(text.encode()) == want
    assert D.term_counts(b"") == Counter() and D.term_counts(b" 12 !") == Counter()


def test_every_case_at_low_thresholds(spark):
    rows = [r for r in ROWS if r[0] is None or r[0] not in (7, 8)]
    for least, top in ((1, 50), (2, 3)):
        assert got(D.audit(frame(spark, rows), least=least, top=top)) == brute(rows, least, top)
    assert got(D.audit(empty(spark))) == []


def test_long_texts_and_no_kept_terms(spark):
    out = got(D.audit(frame(spark)))  # no term is in 30 documents
    assert out == brute(ROWS) and all(r[2] == "pair" and r[4] == 0 for r in out)
    assert got(D.audit(frame(spark), least=1, top=5)) == brute(ROWS, 1, 5)


def test_tiles_and_buckets(spark, monkeypatch):
    """Many sources, one with a third of all rows, over several tiles and buckets."""
    rows = [(i, " ".join(f"{a}{b}" for a in "abcde" for b in "vwxyz" if (ord(a) * i + ord(b)) % (3 + i % 4) == 0) + " same words",
             "en" if i % 5 else "de", "hot" if i % 3 == 0 else f"s{i % 23}") for i in range(600)]
    rows += [(1000 + i, None, "en", f"none{i}") for i in range(3)]
    rows += [(2000, "unseen only", "xx", "a"), (2001, "", "xx", None)]
    rows += [(3000, "same words", "solo", "a")] * 40
    want = brute(rows, 30, 4)
    for tile, terms in ((256, 256), (4, 3)):
        monkeypatch.setattr(D, "TILE", tile)
        monkeypatch.setattr(D, "TERMS", terms)
        assert got(D.audit(frame(spark, rows), top=4)) == want


def test_counts_beyond_a_long_times_a_billion(spark):
    df = spark.createDataFrame([(10**13, 10**14, 7)], "n bigint, total bigint, v bigint")
    p = df.select(D.share(df.n, df.total, df.v).alias("p")).first()["p"]
    assert p == 1 + 10**9 * (10**13 + 5) // (10**14 + 35)


def test_held_counts_are_handed_on_in_parts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert got(D.audit(docs)) == brute(rows)
