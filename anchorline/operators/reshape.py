"""Tall to wide, outer assembly, stacking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary(frames: Sequence[tuple[DataFrame, str]], name: str = "event") -> DataFrame:
    """Distinct names of each source, stacked (a name used by two sources is listed twice)."""
    parts = [df.select(F.col(column).alias(name)).distinct() for df, column in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Columns that a table made from values may have.
MOST_COLUMNS = 2000


def discover_values(df: DataFrame, column: str, limit: int = MOST_COLUMNS) -> list:
    """Distinct values to become columns, sorted: as many as the result shall have columns. It fails rather than return
    more than `limit`."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = values.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; too many for columns")
    return sorted(r[0] for r in rows)


def pivot_values(df: DataFrame, keys: Sequence[str], concept: str, value: str, values: Sequence[str],
                 strict: bool = False) -> DataFrame:
    """One column per concept, one row per key, in a single aggregate.

    A key with two rows for one concept has no wide form: `strict` makes the query fail there,
    otherwise the larger value is kept.
    """
    aggs = []
    for name in values:
        here = F.col(concept) == F.lit(name)
        cell = F.max(F.when(here, F.col(value)))
        if strict:
            message = F.lit(f"more than one row per key for {name}")
            cell = F.when(F.count(F.when(here, 1)) > 1, F.raise_error(message)).otherwise(cell)
        aggs.append(cell.alias(str(name)))
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def presence_columns(concept: str, values: Sequence[str], prefix: str = "", when: Column | None = None) -> list[Column]:
    """Aggregates of a presence pivot: TRUE where the group has the concept (and `when` holds), else NULL."""
    met = F.lit(True) if when is None else when
    return [F.max(F.when((F.col(concept) == F.lit(v)) & met, True)).alias(f"{prefix}{v}") for v in values]


def presence_pivot(df: DataFrame, keys: Sequence[str], concept: str, values: Sequence[str],
                   prefix: str = "") -> DataFrame:
    """One boolean column per concept: TRUE where the subject has it, else NULL."""
    aggs = presence_columns(concept, values, prefix)
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def full_outer(frames: Sequence[DataFrame], on: str | list[str]) -> DataFrame:
    """Full-outer chain with one coalesced key."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def assemble(spine: DataFrame, frames: Sequence[DataFrame], on: str | list[str]) -> DataFrame:
    """`full_outer` for frames whose keys all occur in `spine`: left joins then give the same rows,
    and the spine keeps its partitioning from join to join."""
    return reduce(lambda a, b: a.join(b, on, "left"), frames, spine)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by position and drop repeats; names come from the first frame."""
    width = len(frames[0].columns)
    if any(len(f.columns) != width for f in frames):
        raise ValueError("all frames need the same number of columns")
    return reduce(lambda a, b: a.union(b), frames).distinct()
