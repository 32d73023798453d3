"""Incremental appends."""
