"""Integrity analytics for machine-learning data, written as Spark DataFrame operators."""

__version__ = "0.1.0"
