"""Spark-first text-corpus curation, citation audit, retrieval and evaluation."""
