"""Operators that prepare training text: dedup, filters, tokenizers, formatting."""
