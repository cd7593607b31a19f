"""Describe and subset N-dimensional array datasets with Spark DataFrames."""

__version__ = "0.1.0"
