"""Operators for training-data pipelines: scoring, deduplication, tokens, archives, packing, media."""
