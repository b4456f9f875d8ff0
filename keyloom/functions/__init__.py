"""Column functions: patterns, keys, numbers and JSON paths."""
