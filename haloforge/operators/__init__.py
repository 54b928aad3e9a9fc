"""Operators over canonical DataFrames."""
