"""Leakage-free experiments on Spark DataFrames."""
