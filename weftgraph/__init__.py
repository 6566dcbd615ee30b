"""Spark-native engine that turns text and key-related tables into a vector index of passages and a labelled graph."""

__version__ = "0.1.0"
