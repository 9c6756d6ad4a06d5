"""Readers, writers and generators of tables."""
