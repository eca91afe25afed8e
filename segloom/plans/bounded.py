"""Driver-side tables with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows when there are at most ``limit``, else None. Never fetches more than that."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows
