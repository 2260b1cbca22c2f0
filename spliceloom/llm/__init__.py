"""Operators for preparing training text: dedup, quality, privacy, tokens."""
