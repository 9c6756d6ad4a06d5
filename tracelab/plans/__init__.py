"""Compositions of operators, and queries over the test tables."""
