"""Operators for large training corpora, built on Spark DataFrames."""
