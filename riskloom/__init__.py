"""riskloom: a Spark-native toolkit for building, evaluating and applying binary risk-scoring
models on large tables."""

__version__ = "0.1.0"
