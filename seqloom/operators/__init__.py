"""Operators on read DataFrames."""
