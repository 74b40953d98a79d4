"""Smallest and largest values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax(df: DataFrame, keys: Sequence[str], value: str, low: str = "min", high: str = "max") -> DataFrame:
    """Minimum and maximum per group, NULLs ignored; NULL for a group with no value."""
    return df.groupBy(*keys).agg(F.min(value).alias(low), F.max(value).alias(high))
