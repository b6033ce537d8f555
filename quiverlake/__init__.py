"""Quiverlake: similarity search, retrieval and evaluation over Spark DataFrames."""

__version__ = "0.1.0"
