"""Spark-native document structuring and embedding analytics."""

__version__ = "0.1.0"
