from collections import Counter

import corpus_pipeline as C
import pytest
from helpers import ROWS, empty, frame, words
from pyspark.sql import functions as F

from riskloom.llm.common import staged

SF = "/root/testdata/sf0.01"


def test_stages_on_every_case(spark):
    docs = frame(spark)
    for name, stage in C.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    last = C.STAGES[-1][1](spark, docs, SF)
    assert Counter(r["doc_id"] for r in last.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_empty_table(spark):
    for _, stage in C.STAGES:
        assert stage(spark, empty(spark), SF).collect() == []


def test_redaction_changes_only_texts_with_secrets(spark):
    before = {(r["doc_id"], r["text"]): r for r in frame(spark).collect()}
    after = C.redact_secrets(spark, frame(spark), SF).collect()
    assert len(after) == len(ROWS)
    for r in after:
        if r["doc_id"] == 12:
            assert "24be" not in r["text"] and "AKIA" not in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == before[r["doc_id"], r["text"]]


def test_whole_run_follows_its_stages(spark):
    """Row by row against the stages applied to what the one before kept."""
    from riskloom.llm import bpe, jaccard_join, mixing, toxicity
    from riskloom.llm.queries import multilingual_vocabulary
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.digest(docs, labels).collect()}
    kept = docs.where(F.col("doc_id").isin([i for i, p in scores.items() if not p]))
    near = jaccard_join.classes(kept, words=C.NEAR_WORDS, least=C.NEAR_LEAST)
    classes = {r["doc_id"]: r["component_id"] for r in near.collect()}
    first = kept.where(F.col("doc_id").isin([i for i, c in classes.items() if i == c]))
    clean = C.redact_secrets(spark, first, SF)
    sizes = {r["doc_id"]: len(words(r["text"])) for r in clean.collect()}
    times = {r["doc_id"]: r["taken"] // sizes[r["doc_id"]] for r in mixing.digest(clean).collect() if r["taken"]}
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(clean, multilingual_vocabulary()).collect()}
    got = C.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(times)
    assert all(list(r["ids"]) == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_exact_top_k", "op7_ngram_jaccard_join", "op11_vector_codes",
                                  "op13_source_divergence"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as E
    from oracle_compare import compare, duck
    r = compare(spark, duck("/root/testdata/sf0.001"), name, E.queries()[name], E.oracle_sql()[name], "/root/testdata/sf0.001")
    assert r["ok"], r["note"]
