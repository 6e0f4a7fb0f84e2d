"""Named queries and their SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def load() -> None:
    """Import the modules that register queries."""
    from marketloom.plans import catalog  # noqa: F401
