"""Readers of the input formats."""
