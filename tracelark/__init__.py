"""Spark-native link-recovery analytics."""
