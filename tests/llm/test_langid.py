import numpy as np
import pytest
from helpers import ROWS, crc, empty, frame
from pyspark.sql import functions as F

from riskloom.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).collect()[0]
    assert n > 200 and right > 0.97


def test_every_case(spark):
    got = langid.digest(frame(spark)).collect()
    assert len(got) == len(ROWS)
    text = {i: t for i, t, _, _ in ROWS if i is not None}
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letters)
    assert langid.digest(empty(spark)).collect() == []


def test_no_labels_and_one_label(spark):
    none = [(i, t, None, s) for i, t, _, s in ROWS]
    assert {r["lang_pred"] for r in langid.digest(frame(spark, none)).collect()} == {"und"}
    one = [(i, t, "nl", s) for i, t, _, s in ROWS]
    assert {r["lang_pred"] for r in langid.digest(frame(spark, one)).collect()} == {"und", "nl"}


def test_prediction_ignores_neighbours_and_equals_the_vector_form():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (3, 50, 400)] + ["ÀÉ été".encode()]
    weights = rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    together = langid.Grams(texts).means(weights)
    alone = np.concatenate([langid.Grams([t]).means(weights) for t in texts])
    assert together == pytest.approx(alone)
    assert together == pytest.approx(langid.Grams(texts).shares().astype(float) @ weights.astype(float), abs=1e-4)


def test_family_comes_first():
    texts = ["the and with of", "der und mit das", "le et avec les", "el y con los"] * 10
    model = langid.Model.fit(["en", "de", "fr", "es"] * 10, texts)
    assert {p[0] for p in model.pairs} == {"family", "germanic", "romance"}
    assert model.predict([t.encode() for t in texts])[0] == ["en", "de", "fr", "es"] * 10
