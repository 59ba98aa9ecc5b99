"""Layered measurement and relationship analytics on Spark."""
