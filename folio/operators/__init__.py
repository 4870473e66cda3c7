"""Operators on document tables, each a function from DataFrames to a DataFrame."""
