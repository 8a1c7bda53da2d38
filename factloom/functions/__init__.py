"""Column functions: spans, keys, JSON paths and patterns."""
