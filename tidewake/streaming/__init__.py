"""Incremental runs over arriving day files."""
