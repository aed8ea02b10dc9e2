"""Spark-native analytics over collections of baseline JPEG images."""
