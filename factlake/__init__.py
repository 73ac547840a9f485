"""Retrieval-based news verification on Spark DataFrames."""
