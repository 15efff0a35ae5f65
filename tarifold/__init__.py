"""Spark-native price-list engine."""
