"""Array-expression engine for Spark DataFrames."""

__version__ = "0.1.0"
