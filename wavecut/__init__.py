"""Spark-native analytics for long, ordered sensor signals cut into segments."""
