"""Spark-native analytics for source-code graphs and document corpora."""
