"""Compact binary encoding, dictionary and delta codecs for Apache Spark DataFrames."""

__version__ = "0.1.0"
