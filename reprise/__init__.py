"""Duplicate-sequence analytics on Spark DataFrames."""
