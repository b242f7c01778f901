"""Faultline: Spark-native analytics over incident reports."""
