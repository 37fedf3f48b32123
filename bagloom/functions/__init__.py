"""Monoids and the built-in function table."""
