"""Column builders and small dimension tables."""
