"""Audit, clean, segment and rank relational tables with plain Spark DataFrames."""

__version__ = "0.1.0"
