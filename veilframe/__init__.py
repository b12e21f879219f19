"""Spark-native document inspection and redaction engine."""
