"""Operators for large-scale training text. Nothing outside this package imports it."""
