"""Operators over bars, quarters, feeds and documents."""
