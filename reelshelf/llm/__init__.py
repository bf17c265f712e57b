"""Operators for large-scale training data: cleaning, deduplication, tokens, archives."""
