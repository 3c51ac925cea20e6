"""Operators for preparing training data: filters, duplicate search, mixing, formatting and token files."""
