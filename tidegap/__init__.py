"""Spark-native grouping of timestamped records into coherent sessions ("albums")."""
