import math
import re

import numpy as np
import pytest
from helpers import ROWS, crc, empty, frame

from riskloom.llm import toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02


def test_every_case(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (999, 1, 0), (1, 0, 1)], LABELS)
    got = toxicity.digest(frame(spark), labels).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)
    assert toxicity.digest(empty(spark), labels).collect() == []
    no = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.digest(frame(spark), no).collect()} <= {toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.log(1e-9)).scores([b""])[0]}


TERMS = [("muslim", "christian"), ("musulman", "chrétien"), ("muslime", "christen"), ("musulmán", "cristiano")]


@pytest.mark.parametrize("term,other", TERMS)
def test_swapped_terms_lose_their_weight(term, other):
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(40)]
    texts, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = list(rng.choice(filler, 8)) + (["vile"] if toxic else [])
        # the term goes with the label in the data, as it does in biased collections
        w += [term] if toxic and i % 8 == 0 or not toxic and i % 40 == 1 else []
        texts.append(" ".join(w).encode())
        y.append(float(toxic))
    neutral = [f"word1 {term} word2".encode(), f"word1 {other} word2".encode()]
    biased = toxicity.train(texts, np.array(y), 0.25, counterfactual=0.0).logits(neutral)
    model = toxicity.train(texts, np.array(y), 0.25)
    fair = model.logits(neutral)
    assert abs(fair[0] - fair[1]) < 0.1 * abs(biased[0] - biased[1])
    assert model.scores([b"a vile thing"])[0] > 0.3 > model.scores(neutral).max()


def test_every_identity_term_has_one_group():
    terms = [t for g in toxicity.IDENTITY for t in g]
    assert len(terms) == len(set(terms)) == len(toxicity.swaps())
    for a, b in TERMS:
        assert toxicity.swapped(f"x {a}, y".encode(), {a.encode(): b.encode()}) == f"x {b}, y".encode()


def test_scores_match_a_plain_recount(spark):
    """Every score from the model's weights, with words and beginnings taken by a pattern and each counted once."""
    texts = [b"a vile word here", b"a kind word there", b"vileness abounds", b"kindness abounds"] * 8
    model = toxicity.train(texts, np.array([1.0, 0.0] * 16), 0.5, least=1)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = toxicity.score(frame(spark), model, ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", text))
        used = set()
        for w in words:
            one = toxicity.Words([w], toxicity.OTHER)
            used.add(int(one.hashes()[0]))
            used |= {int(one.span_hashes(np.array([0]), np.array([n]), kind=1)[0]) for n in toxicity.PREFIXES if len(w) > n}
        logit = model.bias + sum(weights.get(k, 0.0) for k in used)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
        assert r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)


def test_swap_keeps_the_rest():
    table = toxicity.swaps()
    assert toxicity.swapped(b"The women, and men.", table) == b"the men, and women."
    assert toxicity.swapped(b"nobody here", table) is None
