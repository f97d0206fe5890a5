"""Operators of a training-data pipeline (text, pages, embeddings) and their queries."""
