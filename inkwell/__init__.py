"""Inkwell: ranked text retrieval and inverted-index analytics on Spark DataFrames."""
