"""The index interval of each subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.functions.clean import current_version, in_concepts
from anchorline.functions.concepts import CLASS_DATE, INDEX_START, INDEX_STOP


def index_events(cohort: DataFrame, clinical_event: DataFrame, ce_date_result: DataFrame,
                 codes: Sequence[int] = (INDEX_START, INDEX_STOP)) -> DataFrame:
    """Charted start and stop times of the cohort: encounter and person must both match, and only
    the current version of the date result counts."""
    charted = clinical_event.where(
        (F.col("event_class_cd") == F.lit(CLASS_DATE)) & in_concepts("event_cd", codes)
    ).select("encntr_id", "person_id", "event_id", "parent_event_id", "event_cd")
    dates = ce_date_result.where(current_version()).select("event_id", "result_dt_tm")
    return (
        charted.join(cohort.select("encntr_id", "person_id"), ["encntr_id", "person_id"], "left_semi")
        .join(dates, "event_id")
        .select("encntr_id", "event_id", "parent_event_id", "event_cd", "result_dt_tm")
    )


def index_interval(events: DataFrame, keys: Sequence[str], code: str, ts: str, start_code, stop_code,
                   start_as: str = "start_ts", stop_as: str = "stop_ts") -> DataFrame:
    """Earliest start and latest stop per group, from one scan and one aggregate."""
    return events.where(F.col(code).isin([start_code, stop_code])).groupBy(*keys).agg(
        F.min(F.when(F.col(code) == F.lit(start_code), F.col(ts))).alias(start_as),
        F.max(F.when(F.col(code) == F.lit(stop_code), F.col(ts))).alias(stop_as),
    )


def first_index(intervals: DataFrame, key: str, start: str = "start_ts", first_as: str = "first_start_ts") -> DataFrame:
    """Earliest start per subject; subjects without any start are left out."""
    return intervals.where(F.col(start).isNotNull()).groupBy(key).agg(F.min(start).alias(first_as))


def index_interval_outer(cohort: DataFrame, intervals: DataFrame, subject: str, parent: str,
                         start: str = "start_ts", stop: str = "stop_ts") -> DataFrame:
    """Cohort -> its index groups -> start and stop, all outer.

    `intervals` is the result of `index_interval` by (subject, parent), best as a written table, as it is used
    twice. Start and stop are looked up by the parent alone: a group without a parent keeps NULL times, and a
    parent shared by several subjects gives each of them all its starts and the latest stop. A subject without
    a group keeps one row of NULLs; such rows are added to the inner join, because Spark can split a subject
    with very many groups in an inner join, but not in an outer one.
    """
    known = intervals.where(F.col(parent).isNotNull())
    last = known.groupBy(parent).agg(F.max(stop).alias(stop), F.max(start).alias("__any"))
    starts = known.where(F.col(start).isNotNull()).select(parent, start).distinct()
    nothing = F.lit(None).cast(intervals.schema[start].dataType).alias(start)
    times = last.drop("__any").join(starts, parent).select(parent, start, stop).unionAll(
        last.where(F.col("__any").isNull()).select(parent, nothing, stop)
    )
    groups = known.select(subject, parent).join(times, parent).unionByName(
        intervals.where(F.col(parent).isNull()).select(subject, parent), allowMissingColumns=True
    )
    alone = cohort.join(intervals.select(subject).distinct(), subject, "left_anti")
    return (
        cohort.join(groups, subject).unionByName(alone, allowMissingColumns=True)
        .select(*cohort.columns, parent, start, stop).distinct()
    )
