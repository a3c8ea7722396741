"""Operators over DataFrames of vectors and records."""
