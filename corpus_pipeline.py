"""A corpus pipeline: reject toxic documents, keep one of each near-copy class, redact secrets, mix
the sources, and encode.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of their input. ``run`` writes each stage's result
as Parquet in the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from riskloom.llm.common import staged
from riskloom.llm.queries import multilingual_vocabulary
from riskloom.sources.tables import read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 0. Learned from the labels of the learnable documents
    among ``docs``; null text scores as the empty text."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.learnable("doc_id")))
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return toxicity.score(rows, model, ["_row"]).where("predicted = 0").select("_row.*")


# near copies: shingles of five words, resemblance of 0.8 or more
NEAR_WORDS, NEAR_LEAST = 5, (80, 100)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of linked documents; rows without an id
    and texts without words stay."""
    return jaccard_join.one_of_each(docs, words=NEAR_WORDS, least=NEAR_LEAST)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each found span replaced by a mark; ``n_chars`` follows the text, null
    text stays null."""
    found = secret_scan.scan(docs.select(F.struct("*").alias("_row"), "text"), keep=("_row",))
    found = found.select("_row", F.when(F.col("_row.text").isNotNull(),
                                        secret_scan.redact(F.col("scanned_text"), F.col("spans"))).alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed = F.col("_clean").isNotNull() & (F.col("_clean") != F.col("_row.text"))
        new["n_chars"] = (F.when(changed, F.length("_clean")).otherwise(F.col("_row.n_chars"))
                          .cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times)."""
    return mixing.mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every row; null text has none."""
    out = bpe.encode(docs, multilingual_vocabulary())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_bytes),
]

# SQL cannot express the classifier, the rounding draws or the merges; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
