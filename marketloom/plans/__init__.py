"""Queries that exercise the operators, with their SQL."""
