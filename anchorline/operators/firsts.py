"""First and last values and rows with stated tie rules.

All are aggregates: every task reduces a group to one row before the shuffle, so a group of any size is
never gathered. A ranking window would sort each group in one task wherever the rows already lie together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.times import micros


def first_value(value: str, ts: str) -> Column:
    """Largest value among the rows tied at the earliest time; a NULL time is later than any other."""
    return F.max(F.struct(-micros(ts), F.col(value).alias("value")))["value"]


def last_value(value: str, ts: str) -> Column:
    """Largest value among the rows tied at the latest time; a NULL time is later than any other."""
    return F.max(F.struct(F.col(ts).isNull(), F.col(ts), F.col(value).alias("value")))["value"]


def keep_first(df: DataFrame, keys: Sequence[str], ts: str, values: Mapping[str, str],
               time_as: str | None = None) -> DataFrame:
    """Per group the first of each value {output: column}, each on its own; optionally the first time."""
    aggs = [F.min(ts).alias(time_as)] if time_as else []
    aggs += [first_value(column, ts).alias(out) for out, column in values.items()]
    return df.groupBy(*keys).agg(*aggs)


def keep_last(df: DataFrame, keys: Sequence[str], ts: str, values: Mapping[str, str],
              time_as: str | None = None) -> DataFrame:
    """Per group the last of each value {output: column}, each on its own; optionally the last time."""
    aggs = [F.max(ts).alias(time_as)] if time_as else []
    aggs += [last_value(column, ts).alias(out) for out, column in values.items()]
    return df.groupBy(*keys).agg(*aggs)


def nulls_last(column: str | Column) -> Column:
    """Order by a column, missing values last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(c.isNull().alias("missing"), c.alias("value"))


def latest_first(ts: str) -> Column:
    """Order by a time, latest first and missing times last."""
    return nulls_last(-micros(ts))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the smallest by `order`, then by all other columns, so the pick never depends
    on arrival. NULL keys form one group; plain columns put NULL first."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"__rank_{i}") for i, o in enumerate(order)]
    smallest = F.min(F.struct(*ranks, *(F.col(f"`{c}`") for c in rest))).alias("__row")
    picked = df.groupBy(*keys).agg(smallest)
    return picked.select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*(f"`{c}`" for c in df.columns))


def first_row_per_concept(df: DataFrame, subject: str, concept: str, ts: str,
                          tie: Sequence[str | Column] = ()) -> DataFrame:
    """First row per (subject, concept) by time; rows without a time are ignored."""
    return first_rows(df.where(F.col(ts).isNotNull()), [subject, concept], [ts, *tie])


def first_row_per_subject(df: DataFrame, subject: str, ts: str, tie: Sequence[str | Column] = ()) -> DataFrame:
    """First row per subject by time, all columns kept; a row without a time only if there is no other."""
    return first_rows(df, [subject], [nulls_last(ts), *tie])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Drop repeats of a key and keep the first by a stated order (not by arrival)."""
    return first_rows(df, keys, order)
