"""Functional, Spark-first analytics over DataFrames."""

__version__ = "0.1.0"
