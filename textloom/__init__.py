"""Spark-native text analytics: preparation, features, aggregation."""
