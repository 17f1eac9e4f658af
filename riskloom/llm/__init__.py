"""Operators of a training-data pipeline: scans, search, sketches, sharding, classifiers,
mixing, similarity joins, language-model scoring and tokenisation, all as Spark jobs."""
