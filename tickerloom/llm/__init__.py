"""Operators on training text: search, quality, deduplication, packing, language, tokens."""
