"""Spark-first analytics engine: governed metrics, movement analysis and corpus preparation."""

__version__ = "0.1.0"
