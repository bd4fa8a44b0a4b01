"""Spark-native temporal analytics engine."""
