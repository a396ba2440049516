"""Spark-native curation, deduplication and evaluation of text datasets."""
