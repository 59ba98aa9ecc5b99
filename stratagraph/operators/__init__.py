"""Operators on DataFrames, each parameterised by column names."""
