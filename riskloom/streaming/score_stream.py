"""Scoring on a stream: cleaned rows arrive as files, are encoded against the fitted feature
dictionary (stream-static lookup joins) and scored by the broadcast model.

Both steps are per-row given the fitted tables, so the same operators run unchanged on a
streaming DataFrame. The sink is an exactly-once Parquet file sink whose progress lives in
the shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.dictionary import FeatureDictionary
from ..operators.encode import encode_xi_xv
from ..plans.models import Dims
from ..plans.score import score_batch
from ..session import shared_path


def scored_stream(stream: DataFrame, fd: FeatureDictionary, model: str, params: dict, dims: Dims,
                  key: str, seed: int = 42) -> DataFrame:
    """Streaming (key, score) from a streaming DataFrame of cleaned rows."""
    enc = encode_xi_xv(stream, fd, key, None, seed)
    return score_batch(enc, model, params, dims, key)


def run_score_stream(spark: SparkSession, source_path: str, schema: StructType, fd: FeatureDictionary,
                     model: str, params: dict, dims: Dims, key: str, sink_path: str | None = None,
                     checkpoint: str | None = None, seed: int = 42) -> str:
    """Score every file available under ``source_path`` (``availableNow`` trigger) into a
    Parquet sink; returns the sink path."""
    sink_path = sink_path or shared_path(spark, "scored-stream")
    checkpoint = checkpoint or os.path.join(sink_path + "-checkpoint")
    stream = spark.readStream.schema(schema).parquet(source_path)
    query = (scored_stream(stream, fd, model, params, dims, key, seed).writeStream
             .format("parquet").outputMode("append")
             .option("path", sink_path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sink_path
