"""Operators over DataFrames for programs that don't go through query texts."""
