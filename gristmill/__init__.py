"""Gristmill: message and document scoring on Spark DataFrames."""
