"""Spark-native EDI mapping validation."""
