"""Queries over the given tables, and whole jobs."""
