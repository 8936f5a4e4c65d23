"""Spark-native analytics for multi-view phenotyping, detection and point-cloud tables."""
