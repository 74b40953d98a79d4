"""Row numbers over a whole table, and id lists in batches."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions.concepts import EXTRACT_BATCH
from anchorline.session import small_table, stable


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Number all rows 0, 1, 2 ... by `order` without a global window.

    Rows are range-partitioned and sorted; the place within its partition is written with each row, and
    the driver adds up one count per partition. `order` has to be a total order.
    """
    placed = stable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftright("__place", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = small_table(
        df.sparkSession, ((p, s) for (p, _), s in zip(counts, starts)), "__part long, __start long"
    )
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(name, F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__start", "__place")
    )


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], block: int = 100_000) -> DataFrame:
    """Add `upto_<column>` for each column of `sums`: its sum over the rows of the same keys up to this one, by `order`. Keys
    and order together are a total order.

    Rows are numbered over the whole table and summed in blocks; each block starts from the sums of the blocks before, of
    which there is one row per key and block. So one frequent key is many blocks, and no task holds more."""
    numbered = with_row_index(df, [*keys, *order], "__index").withColumn(
        "__block", F.call_function("div", F.col("__index"), F.lit(block))
    )
    ahead = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy(*keys, "__block").agg(*(F.sum(c).alias(c) for c in sums)).select(
        *keys, "__block", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__ahead_{c}") for c in sums)
    )
    within = Window.partitionBy(*keys, "__block").orderBy("__index").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.join(blocks, [*keys, "__block"]).select(
        *df.columns, *((F.sum(c).over(within) + F.col(f"__ahead_{c}")).alias(f"upto_{c}") for c in sums)
    )


def batch_ids(df: DataFrame, key: str, n: int = EXTRACT_BATCH, sep: str = ";") -> DataFrame:
    """Distinct non-NULL ids in key order, `n` per delimited string: (batch, n_ids, ids)."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    numbered = with_row_index(ids, [key], "__index")
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("__index", F.col(key).cast("string").alias("id")))),
        lambda x: x["id"],
    )
    return (
        numbered.groupBy(F.call_function("div", F.col("__index"), F.lit(n)).alias("batch"))
        .agg(F.count("*").alias("n_ids"), F.array_join(ordered, sep).alias("ids"))
    )
