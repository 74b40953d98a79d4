"""Joins of measurements to anchors by subject and time.

A join on the subject alone would compare every measurement of a subject with every anchor of that
subject. The time line is therefore cut into cells, and the join runs on (subject, cell). A subject with
very many rows is thereby spread over many tasks, and the exact time test is repeated afterwards.

Cells come in levels, each twice as wide as the one below. An interval belongs to the lowest level whose cells
are not shorter than itself, so it touches two or three cells however long it is; a mistyped date far in the future
costs no more rows than any other. A point falls into one cell of each level that occurs, nearly always one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions.times import elapsed, micros
from anchorline.operators.firsts import first_rows, latest_first

DAY = timedelta(days=1)
NONE = timedelta(0)


def _level(lo: Column, hi: Column, width: timedelta) -> Column:
    """How often `width` has to be doubled to be as long as the interval (one more or less does no harm)."""
    doublings = F.ceil(F.log2((micros(hi) - micros(lo)) / F.lit(width // timedelta(microseconds=1))))
    return F.greatest(F.coalesce(doublings, F.lit(0)), F.lit(0)).cast("int")


def _cell(ts: Column, width: timedelta, level: Column) -> Column:
    """Number of the cell of a level that holds `ts`; never decreases with time."""
    base = F.lit(width // timedelta(microseconds=1)).cast("long")
    return F.call_function("div", micros(ts), F.call_function("shiftleft", base, level))


def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], ts: str, lo: Column, hi: Column,
                  width: timedelta = DAY) -> DataFrame:
    """Inner join: equal `on` and lo <= ts <= hi, both ends included. Rows with a NULL time or bound
    find no partner. Apart from `on` the two sides share no column name."""
    shared = (set(points.columns) & set(intervals.columns)) - set(on)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    bounded = (
        intervals.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi")
        .withColumn("__level", _level(F.col("__lo"), F.col("__hi"), width))
    )
    at = lambda ts: _cell(F.col(ts), width, F.col("__level"))
    right = bounded.withColumn("__cell", F.explode(F.sequence(at("__lo"), at("__hi"))))
    levels = bounded.select(F.collect_set("__level")).scalar()  # a few dozen numbers at the very most
    left = points.withColumn("__level", F.explode(levels)).withColumn("__cell", at(ts))
    return (
        left.join(right, [*on, "__level", "__cell"])
        .where(F.col(ts).between(F.col("__lo"), F.col("__hi")))
        .drop("__level", "__cell", "__lo", "__hi")
    )


def in_interval_window(measures: DataFrame, anchors: DataFrame, on: Sequence[str], ts: str, start: str, stop: str,
                       before: timedelta = NONE, after: timedelta = NONE, width: timedelta = DAY) -> DataFrame:
    """Measurements from start - before to stop + after. A missing start or stop gives no row."""
    lo = F.col(start) - F.lit(before)
    hi = F.col(stop) + F.lit(after)
    return interval_join(measures, anchors, on, ts, lo, hi, width)


def in_point_window(measures: DataFrame, anchors: DataFrame, on: Sequence[str], ts: str, anchor: str,
                    before: timedelta, after: timedelta, width: timedelta = DAY) -> DataFrame:
    """Measurements from anchor - before to anchor + after."""
    return in_interval_window(measures, anchors, on, ts, anchor, anchor, before, after, width)


def before_bound(measures: DataFrame, bounds: DataFrame, on: Sequence[str], ts: str, bound: str | Column,
                 inclusive: bool = False) -> DataFrame:
    """Measurements before a bound. `bounds` has one row per key; a NULL bound drops its rows."""
    limit = F.col(bound) if isinstance(bound, str) else bound
    test = F.col(ts) <= limit if inclusive else F.col(ts) < limit
    return measures.join(bounds, [*on]).where(test)


def from_bound(measures: DataFrame, bounds: DataFrame, on: Sequence[str], ts: str, bound: str) -> DataFrame:
    """Measurements at or after a bound. `bounds` has one row per key."""
    return measures.join(bounds, [*on]).where(F.col(ts) >= F.col(bound))


def first_hours(measures: DataFrame, admits: DataFrame, on: Sequence[str], ts: str, admit: str,
                hours: int = 24) -> DataFrame:
    """Measurements up to `hours` after admission, those before admission included."""
    return before_bound(measures, admits, on, ts, F.col(admit) + F.lit(timedelta(hours=hours)), inclusive=True)


def stay_at_anchor(stays: DataFrame, anchors: DataFrame, on: Sequence[str], arrive: str, depart: str, anchor: str,
                   follow_on: timedelta = timedelta(hours=2), width: timedelta = timedelta(days=30),
                   flag: str = "covers", hours: str = "hours_after") -> DataFrame:
    """Stays that cover the anchor, or begin within `follow_on` after it; with the covering flag and
    the signed hours from anchor to arrival."""
    reach = F.greatest(F.col(arrive), F.col(depart))
    joined = interval_join(anchors, stays, on, anchor, F.col(arrive) - F.lit(follow_on), reach, width)
    return joined.withColumns(
        {
            flag: (F.col(anchor) >= F.col(arrive)) & (F.col(anchor) <= F.col(depart)),
            hours: elapsed(arrive, anchor, "hours"),
        }
    ).where(
        F.col(flag) | ((F.col(hours) > 0) & (F.col(hours) <= F.lit(follow_on / timedelta(hours=1))))
    )


def last_before(measures: DataFrame, anchors: DataFrame, on: Sequence[str], ts: str, anchor: str,
                keys: Sequence[str], tie: Sequence[str | Column] = ()) -> DataFrame:
    """Last measurement per `keys` that precedes some anchor of the subject. Preceding some anchor is
    preceding the latest one, so anchors are first reduced to one row per subject."""
    latest = anchors.groupBy(*on).agg(F.max(anchor).alias("__latest"))
    earlier = before_bound(measures, latest, on, ts, "__latest").drop("__latest")
    return first_rows(earlier, keys, [latest_first(ts), *tie])
