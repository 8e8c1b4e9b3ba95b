"""Spark-native analysis of byte content: encodings, languages and media types of binary columns."""

__version__ = "0.1.0"
