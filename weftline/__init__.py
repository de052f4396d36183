"""Spark-native sequence-overlap and training-data analytics."""

__version__ = "0.1.0"
