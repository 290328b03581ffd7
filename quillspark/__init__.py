"""Spark-native counter-snapshot and photo-library analytics."""
