"""A Spark-native engine for building, searching and curating text corpora."""

__version__ = "0.1.0"
