"""Imports every module that registers queries."""

from marketloom.plans import company, documents, files, long_series, price, refreshes, shapes, streams  # noqa: F401
