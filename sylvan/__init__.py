"""sylvan: HTML trees as Spark tables, queried with ordinary DataFrame operations."""

__version__ = "0.1.0"
