"""Coalescent genomics on Spark DataFrames.  The public facade is `genospark.model.Model`."""

__version__ = "0.1.0"
