"""Matched cohort: treated patients and their most similar untreated patients."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions.clean import equals, override
from anchorline.functions.times import compose, elapsed
from anchorline.operators import matching as M
from anchorline.operators.balance import balance_distances
from anchorline.session import small_table, stable

# End dates corrected by hand (patient id, only for this start date, end date).
END_DATE_RULES = [
    (215, None, dt.date(2017, 10, 19)),
    (124, dt.date(2018, 1, 13), dt.date(2018, 1, 13)),
    (80, None, dt.date(2018, 12, 30)),
    (105, None, dt.date(2017, 9, 30)),
    (92, None, dt.date(2019, 2, 8)),
    (18, None, dt.date(2019, 4, 7)),
    (118, None, dt.date(2017, 9, 9)),
    (112, None, dt.date(2017, 11, 5)),
]


def end_date_rules(spark: SparkSession, rules: Sequence[tuple] = END_DATE_RULES) -> DataFrame:
    return small_table(spark, rules, "id long, only_start date, end_date date")


def matching_features(sheet: DataFrame, rules: DataFrame) -> DataFrame:
    """(fin, ca_given, cci, code_duration in minutes) from the hand-kept sheet: id, fin, cci,
    code_start_date, code_start_time, ca_given 0/1, code_end_date, code_end_time."""
    fixed = override(
        sheet.withColumn("only_start", F.col("code_start_date")), rules, ["id"], "code_end_date", "end_date",
        only_when="only_start",
    )
    start, end = compose("code_start_date", "code_start_time"), compose("code_end_date", "code_end_time")
    return fixed.select(
        "fin", equals("ca_given", 1).alias("ca_given"), "cci", elapsed(end, start, "minutes").alias("code_duration")
    )


def matched_cohort(features: DataFrame, id_col: str = "fin", treated: str = "ca_given",
                   covariates: Sequence[str] = ("cci", "code_duration"), **limits: int) -> dict[str, DataFrame]:
    """Score, common support on both sides, 1:1 match: the matched rows, the pairs, the balance before
    and after, the sample counts, and all units with the flags `matched` and `discarded`."""
    features = stable(features)
    M.require_units(features, id_col, [treated, *covariates])
    scored = stable(M.in_support(M.propensity_scores(features, treated, covariates), treated, "distance"))
    pairs = stable(M.greedy_match(scored.where("in_support"), id_col, treated, "distance", **limits))
    flagged = (
        scored.join(M.matched_ids(pairs, id_col).withColumn("matched", F.lit(True)), id_col, "left")
        .withColumns({"matched": F.coalesce("matched", F.lit(False)), "discarded": ~F.col("in_support")})
    )
    return {
        "matched": M.matched_sample(scored.drop("in_support"), pairs, id_col),
        "pairs": M.pair_table(scored, pairs, id_col, treated),
        "balance": M.balance_summary(flagged, treated, ["distance", *covariates], "matched"),
        "counts": M.sample_counts(flagged, treated, "matched", "discarded"),
        "units": flagged,
    }


def matched_distances(cohort: dict[str, DataFrame], treated: str = "ca_given",
                      covariates: Sequence[str] = ("distance", "cci", "code_duration")) -> DataFrame:
    """eCDF and eQQ distances of a matched cohort, before and after matching."""
    return balance_distances(cohort["units"], treated, covariates, "matched")
