"""Filters, projections and cleaning steps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.functions.concepts import OPEN_ENDED_AFTER

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def pick(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project and rename in one step: {new name: old name}."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in mapping.items()))


def rename_lower(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename {old: new}, then lower-case every column name."""
    df = df.withColumnsRenamed(dict(mapping or {}))
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def front(df: DataFrame, first: Iterable[str], drop: Iterable[str] = ()) -> DataFrame:
    """Named columns (or all with a prefix, written 'pre*') first, then all others, minus `drop`."""
    lead: list[str] = []
    for item in first:
        hits = [c for c in df.columns if c.startswith(item[:-1])] if item.endswith("*") else [item]
        lead += [c for c in hits if c not in lead]
    rest = [c for c in df.columns if c not in lead]
    gone = set(drop)
    return df.select(*(F.col(f"`{c}`") for c in lead + rest if c not in gone))


def in_concepts(column: str, codes: Iterable) -> Column:
    """Code (or name) is one of a concept set."""
    return F.col(column).isin(list(codes))


def matches(column: str, pattern: str) -> Column:
    """Regular expression found anywhere in the text."""
    return F.col(column).rlike(pattern)


def concept_or_class(display: str, pattern: str, event_class: str, code: int) -> Column:
    """Either the display name matches or the event is of a class."""
    return F.col(display).rlike(pattern) | (F.col(event_class) == F.lit(code))


def within_limits(column: str, low: float | None, high: float | None, low_open: bool = False) -> Column:
    """low <= x < high (low < x when `low_open`); a missing limit is no limit."""
    x = F.col(column)
    test = F.lit(True)
    if low is not None:
        test = test & ((x > F.lit(low)) if low_open else (x >= F.lit(low)))
    if high is not None:
        test = test & (x < F.lit(high))
    return test


def current_version(column: str = "valid_until_dt_tm", after: dt.date = OPEN_ENDED_AFTER) -> Column:
    """Row is the open-ended version; a plain comparison, so it reaches the parquet scan."""
    midnight = dt.datetime(after.year, after.month, after.day)
    return F.col(column) > F.lit(midnight).cast("timestamp_ntz")


def exclude_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows equal to `value`, and rows where the column is NULL."""
    return df.where(F.col(column) != F.lit(value))


def is_before(ts: str, anchor: str) -> Column:
    """True strictly before the anchor."""
    return F.col(ts) < F.col(anchor)


def to_number(column: str | Column) -> Column:
    """Text as a double; NULL unless the whole text is a finite number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def censored_number(df: DataFrame, column: str, low: str = "censor_low", high: str = "censor_high") -> DataFrame:
    """Replace a text result by its number, with flags for '<' and '>' marks."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumns(
            {low: F.when(F.col(column).isNotNull(), False), high: F.when(F.col(column).isNotNull(), False)}
        )
    return df.withColumns(
        {
            low: F.col(column).contains("<"),
            high: F.col(column).contains(">"),
            column: to_number(column),
        }
    )


def tag(df: DataFrame, column: str, value: str) -> DataFrame:
    """Add a constant column, so that sets can be stacked."""
    return df.withColumn(column, F.lit(value))


def override(df: DataFrame, rules: DataFrame, on: list[str], column: str, replacement: str,
             only_when: str | None = None, rank: str | None = None) -> DataFrame:
    """Replace `column` by the value of the first rule that fits on `on`, else keep it. Rows are not multiplied.

    `only_when` names a rule column that, if not NULL, must equal the same-named data column. `rank` names the rule
    column that orders the rules; without it, rules with a condition come before those without, then the smaller
    condition and value. The rules of one key are a hand-written list and are kept together.
    """
    condition = F.col(only_when) if only_when else F.lit(None)
    rule = F.struct(
        *([F.col(rank).alias("rank")] if rank else []), condition.isNull().alias("always"), condition.alias("only"),
        F.col(replacement).alias("value"),
    )
    listed = rules.groupBy(*(F.col(c).alias(f"__rule_{c}") for c in on)).agg(
        F.array_sort(F.collect_list(rule)).alias("__rules")
    )
    test = F.lit(True)
    for c in on:
        test = test & (F.col(c) == F.col(f"__rule_{c}"))
    fits = lambda r: r["always"] | (r["only"] == F.col(only_when)) if only_when else F.lit(True)
    first = F.get(F.filter("__rules", fits), F.lit(0))["value"]
    return df.join(listed, test, "left").withColumn(column, F.coalesce(first, column)).select(*df.columns)


def dense_booleans(df: DataFrame) -> DataFrame:
    """NULL -> FALSE in every boolean column."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in flags})


def equals(column: str, value) -> Column:
    """Equality as a three-valued boolean."""
    return F.col(column) == F.lit(value)
