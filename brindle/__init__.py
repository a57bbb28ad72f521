"""Spark-first analytics over logs, documents and training data."""
