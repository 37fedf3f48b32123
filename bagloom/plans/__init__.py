"""Syntax trees to DataFrame plans and SQL texts."""
