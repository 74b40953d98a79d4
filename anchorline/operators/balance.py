"""How far the distributions of two groups are apart, before and after matching.

Means can agree while distributions differ. Two distances compare whole distributions, for each covariate:

* eCDF: the difference of the shares of both groups that lie at or below a value, over all values that occur.
* eQQ: the difference of the values of equal rank. The larger group's ranks are spread evenly over the smaller one's, with
  values between two ranks interpolated linearly.

Ranks come from one merge of both groups: values with their counts, in order, with running totals over blocks. A value's
units cover a range of ranks, so no unit is numbered, and a value that most units share is one row. Ranges are joined as
single ranks in pieces of a bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.batches import running_totals, with_row_index
from anchorline.session import stable

SET = ["sample", "variable"]
#: Ranks of one piece of a range.
PIECE = 4096


def _values(df: DataFrame, treated: str, covariates: Sequence[str], matched: str | None) -> DataFrame:
    """(sample, variable, value, n_t, n_c): how many units of each group have a value."""
    samples = {"all": F.lit(True)} | ({"matched": F.col(matched)} if matched else {})
    cells = [
        F.struct(F.lit(name).alias("sample"), F.lit(x).alias("variable"), F.col(x).cast("double").alias("value"),
                 F.col(treated).alias("treated"), use.alias("used"))
        for name, use in samples.items() for x in covariates
    ]
    tall = df.select(F.inline(F.array(*cells))).where("used and value is not null and treated is not null")
    return tall.groupBy(*SET, "value").agg(F.count_if("treated").alias("n_t"), F.count_if(~F.col("treated")).alias("n_c"))


def _ranks(first: Column, last: Column) -> Column:
    """Pieces of the ranks from `first` to `last`."""
    piece = lambda x: F.call_function("div", x, F.lit(PIECE))
    return F.when(first <= last, F.sequence(piece(first), piece(last)))


def _by_rank(ranges: DataFrame, role: str) -> DataFrame:
    """(sample, variable, rank, <role>) of ranges (sample, variable, value, first, last) of ranks."""
    pieces = ranges.select(*SET, "value", "first", "last", F.explode(_ranks(F.col("first"), F.col("last"))).alias("piece"))
    pieces = pieces.repartition(*SET, "piece")  # a long range is many pieces
    low = F.greatest("first", F.col("piece") * PIECE)
    high = F.least("last", F.col("piece") * PIECE + (PIECE - 1))
    roles = {r: F.col("value") if r == role else F.lit(None).cast("double") for r in ("small", "lower", "upper")}
    return pieces.select(*SET, F.explode(F.sequence(low, high)).alias("rank"), *(x.alias(r) for r, x in roles.items()))


def quantile_differences(values: DataFrame) -> DataFrame:
    """(sample, variable, rank, diff) for values with running totals and group sizes (all_t, all_c): the difference of
    the smaller group's value of each rank to the larger group's."""
    fewer_treated = F.col("all_t") <= F.col("all_c")
    pick = lambda t, c, small: F.when(fewer_treated == F.lit(small), F.col(t)).otherwise(F.col(c))
    both = values.select(
        *SET, "value", pick("n_t", "n_c", True).alias("n_s"), pick("upto_n_t", "upto_n_c", True).alias("upto_s"),
        pick("n_t", "n_c", False).alias("n_l"), pick("upto_n_t", "upto_n_c", False).alias("upto_l"),
        (F.least("all_t", "all_c") - 1).cast("decimal(19,0)").alias("d"),
        (F.greatest("all_t", "all_c") - 1).cast("decimal(19,0)").alias("e"),
    ).where("d >= 0")
    # Rank k of the smaller group, from 0, lies at k * e / d in the larger one
    begin = lambda at: (  # noqa: E731  the first k whose place is at or beyond `at`
        f"if(d = 0, if({at} <= 0, 0L, 1L), (greatest(cast({at} as decimal(19,0)), 0) * d + e - 1) div greatest(e, 1))"
    )
    small = both.where("n_s > 0").select(*SET, "value", (F.col("upto_s") - F.col("n_s")).alias("first"),
                                         (F.col("upto_s") - 1).alias("last"))
    large = both.where("n_l > 0")
    last = lambda at: F.least(F.expr(begin(at)) - 1, F.col("d").cast("long")).alias("last")
    lower = large.select(*SET, "value", F.expr(begin("upto_l - n_l")).alias("first"), last("upto_l"))
    upper = large.select(*SET, "value", F.expr(begin("upto_l - n_l - 1")).alias("first"), last("upto_l - 1"))
    ranks = _by_rank(small, "small").unionAll(_by_rank(lower, "lower")).unionAll(_by_rank(upper, "upper"))
    met = ranks.groupBy(*SET, "rank").agg(*(F.max(c).alias(c) for c in ("small", "lower", "upper")))
    sizes = both.select(*SET, "d", "e").distinct()
    past = F.expr("if(d = 0, 0, (rank * e) % greatest(d, 1) / greatest(d, 1))").cast("double")
    there = F.col("lower") + past * (F.coalesce("upper", "lower") - F.col("lower"))
    return met.join(sizes, SET).select(*SET, "rank", F.abs(F.col("small") - there).alias("diff"))


def _middle(df: DataFrame) -> DataFrame:
    """(sample, variable, median) of (sample, variable, rank, diff)."""
    numbered = with_row_index(df, [*SET, "diff", "rank"], "__index")
    spans = numbered.groupBy(*SET).agg(F.min("__index").alias("from"), F.count("*").alias("n"))
    middle = F.col("__index").between(
        F.col("from") + F.call_function("div", F.col("n") - 1, F.lit(2)),
        F.col("from") + F.call_function("div", F.col("n"), F.lit(2)),
    )
    return numbered.join(spans, SET).where(middle).groupBy(*SET).agg(F.avg("diff").alias("eqq_median"))


def balance_distances(df: DataFrame, treated: str, covariates: Sequence[str], matched: str | None = None) -> DataFrame:
    """One row per (sample, variable), 'all' and, with a `matched` flag column, 'matched': mean and largest eCDF difference,
    mean, median and largest eQQ difference. Units without a value do not count; flags count as 0 and 1. Where one
    group has no units there is nothing to compare, and the distances are NULL."""
    values = stable(_values(df, treated, covariates, matched))
    sizes = values.groupBy(*SET).agg(F.sum("n_t").alias("all_t"), F.sum("n_c").alias("all_c"))
    merged = stable(running_totals(values, SET, ["value"], ["n_t", "n_c"]).join(sizes, SET))
    share = lambda g: F.try_divide(f"upto_n_{g}", f"all_{g}")
    gap = F.abs(share("t") - share("c"))
    shares = merged.groupBy(*SET).agg(F.avg(gap).alias("ecdf_mean"), F.max(gap).alias("ecdf_max"))
    diffs = stable(quantile_differences(merged))
    ranks = diffs.groupBy(*SET).agg(F.avg("diff").alias("eqq_mean"), F.max("diff").alias("eqq_max"))
    return shares.join(ranks, SET, "left").join(_middle(diffs), SET, "left").select(
        *SET, "ecdf_mean", "ecdf_max", "eqq_mean", "eqq_median", "eqq_max"
    )
