"""Spark-native retrieval, knowledge lifecycle and corpus preparation."""

__version__ = "0.1.0"
