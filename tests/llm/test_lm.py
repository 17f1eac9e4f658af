import math
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from helpers import ROWS, crc, empty, frame, words

from riskloom.llm import lm
from riskloom.llm.textnp import Words


@pytest.fixture
def vocabulary():
    return lm.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def prob(v, data, kind):
    at = np.searchsorted(v.keys, lm.piece_hash(data, kind))
    return math.exp(v.log[at]) if at < len(v.keys) and v.keys[at] == lm.piece_hash(data, kind) else 0.0


def by_segmentation(v, word):
    """Sum over all cuts of the word, and expected counts of pieces."""
    total, expected = 0.0, Counter()
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            inner = math.prod(prob(v, p, 0) for p in parts[1:])
            ways = [(prob(v, parts[0], 1) * inner, [(parts[0], 1)]), (prob(v, b"", 1) * prob(v, parts[0], 0) * inner, [(b"", 1), (parts[0], 0)])]
            for p, head in ways:
                total += p
                for piece in [*head, *[(x, 0) for x in parts[1:]]]:
                    if p:
                        expected[piece] += p
    return total, expected


def test_lattice_sums_all_segmentations(vocabulary):
    texts = "the café unbelievable xqz 漢 a".encode()
    w = Words([texts])
    counts = np.arange(1.0, len(w.start) + 1)
    expected = np.zeros(len(vocabulary.keys))
    logs = lm.Lattice(vocabulary).run(w, counts, expected)
    sums = Counter()
    for i, log in enumerate(logs):
        total, pieces = by_segmentation(vocabulary, w.text(i))
        assert log == pytest.approx(math.log(total), rel=1e-9)
        for p, n in pieces.items():
            sums[p] += counts[i] * n / total
    for (data, kind), n in sums.items():
        assert expected[np.searchsorted(vocabulary.keys, lm.piece_hash(data, kind))] == pytest.approx(n, rel=1e-7, abs=1e-12)
    assert expected.sum() == pytest.approx(sum(sums.values()))


def brute_base(rows):
    docs = [(i, [*words(t), None]) for i, t, _, _ in rows]
    c = Counter(x for i, w in docs if crc(i) % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(((i, crc(i) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n,
                    round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in docs), key=str)


def test_base_score_matches_brute_force(spark, vocabulary, monkeypatch):
    expected = brute_base(ROWS)
    for small in (False, True):
        if small:
            for name in ("TYPES", "POSTINGS", "TEXT_BYTES"):
                monkeypatch.setattr(lm, name, 50)
        got = lm.digest(frame(spark), vocabulary).collect()
        assert sorted(((*[r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")], round(r["base_score"], 6))
                       for r in got), key=str) == expected
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert len({round(r["score"], 9) for r in got if r["doc_id"] in (1, 2)}) == 1


def test_model_learns_from_training_texts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, f"zorbl quanx {i % 3}", None, None) for i in range(60)]
    learned = lm.digest(frame(spark, rows), lm.Vocabulary(path)).collect()
    none = lm.score(frame(spark, rows[:1]), lm.Vocabulary(path), held_out=lm.F.lit(True)).collect()
    assert min(r["score"] for r in learned) > none[0]["score"]
    assert none[0]["train_tokens"] == 0 and none[0]["n_known"] == 0 and none[0]["base_score"] == 0
    assert lm.digest(empty(spark), lm.Vocabulary(path)).collect() == []


def test_scores_from_scratch_and_twice(spark, vocabulary):
    """The whole score column by enumerated segmentations, learned from the training texts alone;
    the caller's vocabulary stays as it was, so a second call gives the same."""
    texts = ["the cat sat", "a cafe", "cat cat xq", "", "THE sat", "dog", "the dog", "a cat", None, "xq zz"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    before = vocabulary.log.copy()
    first = {r["doc_id"]: r["score"] for r in lm.digest(frame(spark, rows), vocabulary).collect()}
    again = {r["doc_id"]: r["score"] for r in lm.digest(frame(spark, rows), vocabulary).collect()}
    assert first == again and (vocabulary.log == before).all()
    expected, ends = np.zeros(len(vocabulary.keys)), 0
    for i, t in enumerate(texts):
        if crc(i) % 7 == 2:
            continue
        ends += 1
        for w in words(t):
            total, pieces = by_segmentation(vocabulary, w.encode())
            for (data, kind), n in pieces.items():
                expected[np.searchsorted(vocabulary.keys, lm.piece_hash(data, kind))] += n / total
    model = lm.copy.copy(vocabulary)
    model.learned(expected, float(ends))
    for i, t in enumerate(texts):
        log = sum(math.log(by_segmentation(model, w.encode())[0]) for w in words(t)) + model.end
        assert first[i] == pytest.approx(log / math.log(10), rel=1e-6)


def test_counts_beyond_the_broadcast_limit(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_BYTES", 0)
    monkeypatch.setattr(lm, "POSTINGS", 50)
    got = lm.digest(frame(spark), vocabulary).collect()
    assert sorted(((*[r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")], round(r["base_score"], 6))
                   for r in got), key=str) == brute_base(ROWS)
