"""Operators: DataFrames in, DataFrame out, no actions but those that a docstring names."""
