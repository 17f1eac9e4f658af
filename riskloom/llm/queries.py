"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan
    return secret_scan.digest(_documents(spark, sf_dir))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk
    return topk.digest(read_table(spark, sf_dir, "embeddings"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprint
    return fingerprint.digest(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding
    return sharding.digest(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    return langid.digest(_documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing
    return mixing.digest(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join
    return jaccard_join.digest(_documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import lm
    return lm.digest(_documents(spark, sf_dir), lm.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def multilingual_vocabulary():
    """The rank file that the byte-level BPE query uses (see the operator for any other)."""
    import public_tokenizers

    from .bpe import Vocabulary
    return Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    return bpe.digest(_documents(spark, sf_dir), multilingual_vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    return toxicity.digest(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_codes
    return vector_codes.digest(read_table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash
    return simhash.digest(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence
    return divergence.digest(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_exact_top_k, op3_fingerprints, op4_sharding, op5_language_id,
                                    op6_source_mix, op7_ngram_jaccard_join, op8_lm_score, op9_byte_bpe, op10_toxicity,
                                    op11_vector_codes, op12_simhash, op13_source_divergence, pipeline)}
