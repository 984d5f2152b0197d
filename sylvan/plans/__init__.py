"""Plans: selectors and transforms as DataFrame operations."""
