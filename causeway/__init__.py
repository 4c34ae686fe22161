"""Causal evidence and indicator analytics on Spark DataFrames."""
