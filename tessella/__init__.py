"""Typed-collection analytics on Spark DataFrames."""
