"""Spark-native checking and analysis of large tables of experiment runs."""

__version__ = "0.1.0"
