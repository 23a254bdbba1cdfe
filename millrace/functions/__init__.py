"""Expressions: Python text forms, templates, patterns, casts and aggregates."""
