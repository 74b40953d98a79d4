"""Code displays and related events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Right rows of one key that are joined in slices; keys that a sketch returns, and tracks.
FREQUENT, MOST_KEYS, TRACKED = 1_000_000, 100, 10_000


def with_display(df: DataFrame, code_value: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the display text of each code column {code column: new column}; NULL when absent.
    Spark broadcasts the dictionary when its measured size allows."""
    for code, name in columns.items():
        names = code_value.select(F.col("code_value").alias(f"__{name}"), F.col("display").alias(name))
        df = df.join(names, F.col(code) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return df


def frequent_keys(df: DataFrame, on: Sequence[str], least: int) -> dict[int, int]:
    """{hash of a key: rows, about} for the keys that hold `least` rows and more, `MOST_KEYS` at most, as a sketch of bounded
    size counts them in one pass. Rows with a null in the key join nothing and are left out."""
    hashed = df.dropna(subset=[*on]).select(F.xxhash64(*on).alias("key"))
    found = hashed.agg(F.expr(f"approx_top_k(key, {MOST_KEYS}, {TRACKED})").alias("top")).first()["top"]
    return {row["item"]: row["count"] for row in found or [] if row["count"] >= least}


def _split(left: DataFrame, right: DataFrame, on: Sequence[str], least: int) -> tuple[DataFrame, ...] | None:
    """Both sides without the right side's frequent keys, then with these alone; a frequent key's right rows are dealt to
    slices of about `least` rows (`__slice`) and its left rows are repeated for each. None without frequent keys."""
    hot = frequent_keys(right, on, least)
    if not hot:
        return None
    slices = F.create_map(*(F.lit(x) for key, n in hot.items() for x in (key, -(-n // least))))
    kinds = dict(right.dtypes)
    of_left = F.element_at(slices, F.xxhash64(*(F.col(c).try_cast(kinds[c]) for c in on)))
    of_right = F.element_at(slices, F.xxhash64(*on))
    few, many = left.where(of_left.isNull()), left.where(of_left.isNotNull())
    dealt = right.withColumn("__slice", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in right.columns)), of_right))
    copied = many.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), of_left.cast("long") - 1)))
    return few, dealt.where("__slice is null").drop("__slice"), many, copied, dealt.where("__slice is not null")


def left_with_condition(left: DataFrame, right: DataFrame, on: Sequence[str], right_filter, least: int = FREQUENT) -> DataFrame:
    """Left-outer join whose extra condition belongs to ON: rows stay, their right side is NULL.

    Spark can split a frequent key of the right side in an inner join, but not in an outer one. So keys with `least` and
    more right rows are found by a sketch and joined apart, in slices, with the left rows that have no partner after all.
    All other keys take the plain join."""
    wanted = right.where(right_filter)
    parts = _split(left, wanted, on, least)
    if parts is None:
        return left.join(wanted, [*on], "left")
    few, rest, many, copied, dealt = parts
    alone = many.join(dealt.select(*on).distinct(), [*on], "left_anti")
    return few.join(rest, [*on], "left").unionByName(copied.join(dealt, [*on, "__slice"]).drop("__slice")).unionByName(
        alone, allowMissingColumns=True
    )


def _earlier(left: DataFrame, right: DataFrame, on: Sequence[str], ts: str, anchor: str, how: str) -> DataFrame:
    renamed, test = right.withColumnsRenamed({c: f"__key_{c}" for c in on}), F.col(ts) < F.col(anchor)
    for c in on:
        test = test & (F.col(c) == F.col(f"__key_{c}"))
    return left.join(renamed, test, how).drop(*(f"__key_{c}" for c in on))


def outer_before(left: DataFrame, right: DataFrame, on: Sequence[str], ts: str, anchor: str,
                 least: int = FREQUENT) -> DataFrame:
    """Left-outer join on equal keys and `ts` < `anchor`; subjects without an earlier row stay.

    Frequent keys are joined apart as in `left_with_condition`. Some row is earlier than the anchor if the key's first row
    is, so the left rows of such keys without a partner are found with one right row per key."""
    parts = _split(left, right, on, least)
    if parts is None:
        return _earlier(left, right, on, ts, anchor, "left")
    few, rest, many, copied, dealt = parts
    first = dealt.groupBy(*on).agg(F.min(ts).alias("__first"))
    alone = _earlier(many, first, on, "__first", anchor, "left_anti")
    earlier = copied.join(dealt, [*on, "__slice"]).where(F.col(ts) < F.col(anchor)).drop("__slice")
    return _earlier(few, rest, on, ts, anchor, "left").unionByName(earlier).unionByName(alone, allowMissingColumns=True)


def sibling_events(index: DataFrame, events: DataFrame, parent: str) -> DataFrame:
    """All events charted under the parent of an index event."""
    return index.join(events, parent)
