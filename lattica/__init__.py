"""Spark-native graph and tensor analytics."""
