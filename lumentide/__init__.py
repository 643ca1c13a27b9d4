"""Spark-native analytics for per-object measurement tables."""
