"""Spark-native media-intelligence analytics."""
