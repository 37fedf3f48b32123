"""Texts to syntax trees: comprehension queries and array loops."""
