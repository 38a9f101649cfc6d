"""Lumindex: a Spark-native full-text search and relevance analytics engine."""
