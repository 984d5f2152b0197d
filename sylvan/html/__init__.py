"""HTML parsing, serialization and cleaning in plain Python; the Spark operators run these functions inside Arrow maps."""
