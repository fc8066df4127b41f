"""Operators that prepare training text: scoring, deduplication, mixing, encoding. Nothing else in the library imports this."""
