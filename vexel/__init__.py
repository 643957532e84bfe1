"""Filtered vector search on PySpark DataFrames."""
