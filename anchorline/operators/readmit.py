"""Fill-down and readmissions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions.times import cell, elapsed

_LAST_CELL = 2**62


def locf(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], columns: Sequence[str],
         width: timedelta | None = timedelta(days=30)) -> DataFrame:
    """Carry the last non-NULL value of each column forward within `keys`, by (ts, *tie).

    Rows without a time come last. The time line is cut into cells of `width`: values are filled
    within (keys, cell), and each cell starts from the last value of the cells before it, taken from
    a summary of one row per cell. So the history of one subject is never gathered in one task.
    `width=None` fills in one step, for short histories.
    """
    order = [F.col(ts).asc_nulls_last(), *tie]
    slot = F.lit(0) if width is None else F.coalesce(cell(ts, width), F.lit(_LAST_CELL))
    cut = df.withColumn("__cell", slot)
    so_far = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    if width is None:
        return filled.drop("__cell")

    def end(c: str) -> Column:
        row = F.struct(F.col(ts).isNull(), F.col(ts), *tie, F.col(c).alias("value"))
        return F.max(F.when(F.col(c).isNotNull(), row))["value"]

    ends = cut.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__cell").alias("__key_cell")).agg(
        *(end(c).alias(f"__end_{c}") for c in columns)
    )
    earlier = (
        Window.partitionBy(*(f"__key_{k}" for k in keys)).orderBy("__key_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = ends.withColumns(
        {f"__carry_{c}": F.last(f"__end_{c}", ignorenulls=True).over(earlier) for c in columns}
    ).drop(*(f"__end_{c}" for c in columns))
    same = F.col("__cell") == F.col("__key_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return (
        filled.join(carry, same, "left")
        .withColumns({c: F.coalesce(c, f"__carry_{c}") for c in columns})
        .select(*df.columns)
    )


def readmissions(visits: DataFrame, person: str, visit: str, admit: str, index_ts: str, disposition: str,
                 excluded: str, days: int = 30, index_id: str = "index_id", days_as: str = "readmit_days",
                 width: timedelta | None = None) -> DataFrame:
    """Visits 0 < days <= `days` after the person's latest index visit.

    `visits` are the inpatient visits; `index_ts` is not NULL on index visits and starts the clock (the
    study uses the index admission, not the discharge). An index visit resets the clock and is never
    itself a readmission. Visits with the excluded or no disposition are dropped once the clock is set.

    Only index visits of the last `days` days matter. So the time line is cut into cells, each visit goes to
    its cell, each index visit also to the later cells within reach of its admission or of its `index_ts`,
    whichever is later, and the fill-down runs within (person, cell): one pass, one shuffle, and a person with
    very many visits is spread over the cells.
    """
    reach = timedelta(days=days)
    width = width or reach
    is_index = F.col(index_ts).isNotNull()
    here, last = cell(admit, width), cell(F.greatest(admit, index_ts) + F.lit(reach), width)
    placed = visits.where(F.col(admit).isNotNull()).select(
        *visits.columns,
        F.when(is_index, F.col(visit)).alias(index_id),
        F.explode(F.when(is_index, F.sequence(here, last)).otherwise(F.array(here))).alias("__cell"),
    )
    so_far = (
        Window.partitionBy(person, "__cell").orderBy(admit, visit).rowsBetween(Window.unboundedPreceding, 0)
    )
    clock = placed.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in (index_ts, index_id)})
    return (
        clock.where((F.col("__cell") == here) & F.col(index_ts).isNotNull())
        .where(F.col(disposition) != F.lit(excluded))
        .withColumn(days_as, elapsed(admit, index_ts, "days"))
        .where((F.col(days_as) > 0) & (F.col(days_as) <= days))
        .select(*visits.columns, index_id, days_as)
    )
