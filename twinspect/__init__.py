"""Spark-native engine that finds similar units in large collections of code and text."""
