"""Folio: document analytics on Spark DataFrames."""
