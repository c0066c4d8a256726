"""Intermediate tables of these operators: the library's, and joins with tables of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import mark, new_path, shared_dir, sweep, written

__all__ = ["mark", "new_path", "shared_dir", "small", "sweep", "written"]


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most that many rows (some MB); else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
