"""Rule models over very wide binary data, on Spark DataFrames."""

__version__ = "0.2.0"
