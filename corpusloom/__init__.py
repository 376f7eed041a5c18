"""Spark-native engine for curating, measuring and auditing corpora of writing."""

__version__ = "0.1.0"
