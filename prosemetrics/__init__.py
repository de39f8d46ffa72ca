"""Quantitative text analysis on Spark DataFrames."""
