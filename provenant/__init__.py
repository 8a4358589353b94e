"""Provenance analytics on Spark DataFrames: records, claims, chains and execution traces."""

__version__ = "0.1.0"
