"""Violations as tables: an empty one means that all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with the first violations, if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
