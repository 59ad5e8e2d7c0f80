"""Commit-history analytics and large-scale data preparation on PySpark."""

__version__ = "0.1.0"
