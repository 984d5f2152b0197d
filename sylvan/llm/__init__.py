"""Training-data operators: deduplication, filtering, scoring, search, mixing and sharding of text collections.

Nothing outside this subpackage imports it.
"""
