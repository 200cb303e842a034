"""Distributed operators for building, checking and using tabular classifiers on Spark."""

__version__ = "0.1.0"
