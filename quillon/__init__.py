"""Spark-native analytics for labelled boxes, question/answer data and evaluation records."""

__version__ = "0.1.0"
