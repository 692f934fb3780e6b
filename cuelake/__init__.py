"""Cuelake: interval, token and subtitle processing on Spark DataFrames."""
