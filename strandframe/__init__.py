"""Spark-first analytics for interval tables, binary matrices and text corpora."""

__version__ = "0.1.0"
