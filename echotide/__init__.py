"""Spark-native analytics for time-resolved image data."""
