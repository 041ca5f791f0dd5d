"""Spark jobs for corpora and fact sets that change over time."""

__version__ = "0.1.0"
