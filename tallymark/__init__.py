"""Advertising delivery and call attribution analytics on Spark DataFrames."""
