"""Readers, writers and tables derived from the base data."""
