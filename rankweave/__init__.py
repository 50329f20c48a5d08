"""Probabilistic retrieval analytics on Spark DataFrames."""
