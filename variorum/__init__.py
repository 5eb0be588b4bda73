"""Variorum: deterministic document comparison at scale, expressed in Spark DataFrames."""

__version__ = "0.1.0"
