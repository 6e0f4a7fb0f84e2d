"""Operators over text corpora; nothing outside this package imports it."""
