"""Spark-native analytics over property graphs of code and linked text."""
