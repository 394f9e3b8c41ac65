"""Spark-native log ingest, indexing and search."""
