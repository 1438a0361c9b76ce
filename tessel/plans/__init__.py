"""Queries by name over the tables."""
