"""Operators of a training-data pipeline: extraction, filtering, deduplication, tokens, search."""
