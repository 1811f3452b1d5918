"""Operators for preparing training data: dedup, packing, archives, filters, tokens."""
