"""Spark-native analytics for viral-protein annotation."""

__version__ = "0.1.0"
