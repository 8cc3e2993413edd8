"""Operators for preparing training data at scale: search, tokens, filters, deduplication, packing, language."""
