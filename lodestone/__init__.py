"""Lodestone: a Spark-first analytics engine for sentence-level event corpora."""
