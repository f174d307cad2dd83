"""Subword and corpus analytics on Spark DataFrames."""
