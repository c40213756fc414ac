"""Spark-native operators for versioned public-data indicators."""
