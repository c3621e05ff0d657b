"""Spark-native analytics for research-gap corpora."""

__version__ = "0.1.0"
