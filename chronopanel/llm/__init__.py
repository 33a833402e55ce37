"""Operators for preparing training text: language, quality, duplicates, extraction, tokens, packing."""
