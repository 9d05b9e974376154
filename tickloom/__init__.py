"""Spark-native analytics for two-sided quote data."""
