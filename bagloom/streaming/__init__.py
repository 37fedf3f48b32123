"""Incremental queries over streams."""
