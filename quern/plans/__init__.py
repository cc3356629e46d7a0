"""Queries over the test tables: the operators applied, with their SQL equivalents."""
