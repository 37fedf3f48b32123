"""Scans, indices, staging and sinks."""
