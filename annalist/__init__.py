"""Spark-native analytics over code histories: logs, registries, call graphs, commit trees."""

__version__ = "0.1.0"
