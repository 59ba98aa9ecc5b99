"""Plans: the registered queries and the strain pipeline."""

from . import graphs, knowledge, measurements
from .registry import QUERIES

__all__ = ["QUERIES", "graphs", "knowledge", "measurements"]
